"""All queries of the analytics engine by name, each with the SQL it equals where SQL can say it."""

from __future__ import annotations

REGISTRY: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name."""

    def keep(f):
        REGISTRY[name] = (f, sql)
        return f

    return keep


def _loaded() -> dict[str, tuple]:
    from platewise.plans import alignment, domain, foods, generation, names, nutrition, ranking, relational, tables, tasks  # noqa: F401

    return REGISTRY


def queries() -> dict:
    return {name: f for name, (f, _) in _loaded().items()}


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _loaded().items() if sql}
