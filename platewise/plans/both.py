"""Queries that read alike in Spark SQL and in the SQL they are held against."""

from __future__ import annotations

import re

from platewise.plans.catalogue import query
from platewise.sources.tables import read

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_TABLE = re.compile(r"(?<=FROM )(%s)\b|(?<=JOIN )(%s)\b" % ("|".join(TABLES), "|".join(TABLES)))
#: Spark reads a plain 0.5 as a decimal.
_REAL = re.compile(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])")


def doubles(sql: str) -> str:
    return _REAL.sub(r"\1D", sql)


def both(name: str, sql: str, **differs: tuple[str, str]) -> None:
    """Register sql; {word} stands for differs[word], (Spark's form, the other's)."""
    mine, other = doubles(sql), sql
    for word, (a, b) in differs.items():
        mine, other = mine.replace("{%s}" % word, a), other.replace("{%s}" % word, b)

    def run(spark, sf_dir):
        used = {t for m in _TABLE.finditer(mine) for t in m.groups() if t}
        text = _TABLE.sub(lambda m: "{%s}" % m[0], mine.replace("{", "{{").replace("}", "}}"))
        return spark.sql(text, **{t: read(spark, sf_dir, t) for t in used})

    query(name, other)(run)
