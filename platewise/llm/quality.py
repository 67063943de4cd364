"""Quality by a sparse rule ensemble.

Statistics of a text are Spark expressions. Small trees are grown on bootstrap samples of a bounded sample of labelled
rows (SAMPLE rows at most, those with the smallest hash of doc_id); their paths are conjunctive rules; a logistic model
with an L1 penalty (proximal gradient) weighs rules and keeps few; rules and weights are compiled into one Spark
column. Scoring reads each row once and shuffles nothing.

Rows of labels with null or other than 0 and 1 are ignored. Null text counts as empty, and empty texts get a score too.
Without labels of both kinds the score is their rate, or 0.5. Repeated rows get equal scores. An empty table gives no rows;
other columns stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import fresh, held_out

SAMPLE, TREES, LEVELS, THRESHOLD = 20_000, 80, 3, 0.3


def statistics(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")

    def share(characters: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, characters, ""))) / n

    words = F.greatest(F.length(text) - F.length(F.translate(text, " \n\t", "")), F.lit(1)).cast("double")
    lines = F.split(text, "\n")
    return {
        "length": F.log1p(F.length(text).cast("double")),
        "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "digit": share("0123456789"),
        "shout": share("!?"),
        "symbol": share("#$%&*@^~+=_\\"),
        "bracket": share("|<>{}[]"),
        "space": share(" \n\t"),
        "stop": share("."),
        "comma": share(",;:"),
        "word": F.length(text) / words,
        "line": F.length(text) / F.size(lines).cast("double"),
        "repeated": 1 - F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
    }


@dataclass
class Rule:
    tests: tuple[tuple[str, bool, float], ...]  # statistic, whether above, limit
    weight: float

    def column(self, stats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, limit in self.tests:
            out = out & ((stats[name] > limit) if above else (stats[name] <= limit))
        return F.when(out, F.lit(self.weight)).otherwise(F.lit(0.0))


@dataclass
class Ensemble:
    bias: float
    rules: list[Rule]

    def score(self, stats: dict[str, Column]) -> Column:
        terms = [F.lit(self.bias), *(rule.column(stats) for rule in self.rules)]
        while len(terms) > 1:  # a balanced sum: a chain of hundreds is too deep for the analyser
            terms = [sum(terms[i + 1 : i + 2], start=terms[i]) for i in range(0, len(terms), 2)]
        return 1 / (1 + F.exp(-terms[0]))


def grown(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, levels: int) -> list[list[tuple[int, bool, float]]]:
    """The paths (below the root) of one tree, by least squares on some columns and rows."""
    paths, cells = [], [(rng.integers(0, len(y), min(len(y), 2000)), [])]
    for _ in range(levels):
        below = []
        for rows, path in cells:
            best = None
            for c in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
                v = x[rows, c]
                for limit in np.unique(np.quantile(v, np.linspace(0.03, 0.97, 16))):
                    left = v <= limit
                    n = int(left.sum())
                    if 10 <= n <= len(rows) - 10:
                        t, a = y[rows].sum(), y[rows[left]].sum()
                        gain = a * a / n + (t - a) ** 2 / (len(rows) - n) - t * t / len(rows)
                        if gain > 1e-9 and (best is None or gain > best[0]):
                            best = gain, int(c), float(limit), left
            if best:
                _, c, limit, left = best
                for above, own in ((False, rows[left]), (True, rows[~left])):
                    paths.append([*path, (c, above, limit)])
                    below.append((own, paths[-1]))
        cells = below
    return paths


def weighed(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights of an L1-penalised logistic model, by accelerated proximal gradient."""
    w, b = np.zeros(z.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    size = 4 * len(y) / (np.linalg.eigvalsh((z.T @ z).astype(float))[-1] + len(y))
    u, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ u.astype(z.dtype) + c, -30, 30)))
        g = (p - y) / len(y)
        v = u - size * (z.T @ g.astype(z.dtype))
        v, d = np.sign(v) * np.maximum(np.abs(v) - size * penalty, 0), c - size * g.sum()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c, w, b, t = v + (t - 1) / s * (v - w), d + (t - 1) / s * (d - b), v, d, s
    return b, w


def fitted(names: list[str], x: np.ndarray, y: np.ndarray, trees: int = TREES, levels: int = LEVELS, penalty: float = 2e-3, seed: int = 7) -> Ensemble:
    if len(y) == 0 or y.min() == y.max() or len(y) < 20:
        rate = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(float(np.log(rate / (1 - rate))), [])
    rng, rules = np.random.default_rng(seed), {}
    for _ in range(trees):
        for path in grown(x, y - y.mean(), rng, levels):
            rules.setdefault(tuple((names[c], above, round(limit, 6)) for c, above, limit in path), None)
    at = {n: i for i, n in enumerate(names)}
    first, held = {}, []
    for i, rule in enumerate(rules):
        holds = np.all([(x[:, at[n]] > limit) == above for n, above, limit in rule], axis=0)
        # of rules that hold for the same rows, one
        if 0.002 < holds.mean() < 0.998 and first.setdefault(np.packbits(holds).tobytes(), i) == i:
            held.append(holds)
    first = list(first.values())
    if not first:
        return fitted(names, x, y[:0])
    bias, weights = weighed(np.array(held, np.float32).T, y, penalty)
    kept = list(rules)
    return Ensemble(bias, [Rule(kept[i], float(w)) for i, w in zip(first, weights, strict=True) if abs(w) > 1e-6])


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    """From labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    marked = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 0))
    marked = marked.groupBy("doc_id").agg(F.avg("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    stats = statistics(F.col("text"))
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("row"), F.struct(*[c.alias(n) for n, c in stats.items()]).alias("s"))
    # an id that repeats counts once, with its text of the smallest hash
    rows = rows.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min_by("s", "row").alias("s"))
    data = rows.select("doc_id", "quality", "s.*").toPandas().sort_values("doc_id")
    return fitted(list(stats), data[list(stats)].to_numpy(float), (data["quality"].to_numpy(float) >= 0.5).astype(float))


def scored(docs: DataFrame, model: Ensemble, out: str = "score") -> DataFrame:
    """docs and their score (in place of a column of that name). The statistics are computed in one pass before the rules read them."""
    stats = statistics(F.col("text"))
    held, score = fresh(docs, "statistics", "score_of")
    done = docs.withColumn(held, F.struct(*[c.alias(n) for n, c in stats.items()]))
    # a stage of its own: else each rule would compute its statistics again
    done = done.withColumn(score, F.get(F.transform(F.array(held), lambda s: model.score({n: s[n] for n in stats})), F.lit(0))).drop(held)
    return done.drop(out).withColumnRenamed(score, out)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    done = scored(docs.select("doc_id", "text"), learned(docs, labels))
    return done.select("doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
