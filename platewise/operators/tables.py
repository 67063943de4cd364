"""Filters with fallbacks, reshaping, sampling and ordering of whole tables.

Draws come from a hash of keys and a seed, so a run can be repeated and each task draws for its own rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(*keys: Column, seed: int | str = 42) -> Column:
    """A number in [0, 1) that keys and seed decide: the first 32 bits of an md5."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


# --- columns

def subset(df: DataFrame, keep: Sequence[str], casts: Mapping[str, str] | None = None) -> DataFrame:
    """The columns of keep that are there, some of them cast; what is not there is left out."""
    have = {c.lower(): c for c in df.columns}
    casts = casts or {}
    return df.select(*[F.col(have[c.lower()]).try_cast(casts[c]).alias(have[c.lower()]) if c in casts else F.col(have[c.lower()]) for c in keep if c.lower() in have])


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def canonical(df: DataFrame, names: Mapping[str, Sequence[str]]) -> DataFrame:
    """Columns renamed to the canonical name of which they are the first alias there, in any case."""
    have, put = {c.lower(): c for c in df.columns}, {}
    for name, aliases in names.items():
        found = next((have[a.lower()] for a in (name, *aliases) if a.lower() in have), None)
        if found:
            put[found] = name
    return df.withColumnsRenamed(put)


def required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, if it has the columns; else an error before any job runs."""
    if missing := [c for c in columns if c.lower() not in {x.lower() for x in df.columns}]:
        raise KeyError(f"columns {missing} are not among {df.columns}")
    return df


def int_or_kept(text: Column) -> Column:
    """12.0 as 12; what is no number stays."""
    return F.coalesce(text.try_cast("double").try_cast("bigint").cast("string"), text)


def finite(value: Column) -> Column:
    """null for NaN and infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def per_serving(df: DataFrame, values: Sequence[str], servings: str) -> DataFrame:
    """Values divided by servings; none or 0 servings count as 1."""
    by = F.coalesce(F.nullif(F.col(servings).cast("double"), F.lit(0.0)), F.lit(1.0))
    return df.withColumns({c: F.col(c) / by for c in values})


def meal_scale(energy: Column) -> Column:
    """The factor that makes a recipe one meal: a side thrice, large ones by half or a third."""
    return F.when(energy < 200, 3.0).when(energy < 900, 1.0).when(energy < 1500, 0.5).otherwise(1.0 / 3.0)


# --- filters

def with_minimum(df: DataFrame, test: Column, least: int) -> DataFrame:
    """Rows that pass, if there are `least`; else all. One row of counts is broadcast, the table is read once for it."""
    n = df.agg(F.count_if(test).alias("n_passed"))
    return df.crossJoin(F.broadcast(n)).where(test | (F.col("n_passed") < least)).drop("n_passed")


def with_group_minimum(df: DataFrame, keys: Sequence[str], strict: Column, loose: Column, least: int) -> DataFrame:
    """Per group: rows that pass the strict test, if there are `least`; else those that pass the loose one."""
    n = df.groupBy(*keys).agg(F.count_if(strict).alias("n_strict"))
    return df.join(n, list(keys)).where(F.when(F.col("n_strict") >= least, strict).otherwise(loose)).drop("n_strict")


def within(bounds: Mapping[str, tuple[float, float]], needed: Sequence[str] = ()) -> Column:
    """Whether every value is missing or within its bounds, and the needed ones are there."""
    tests = [F.col(c).isNotNull() & F.col(c).between(*b) if c in needed else F.col(c).isNull() | F.col(c).between(*b) for c, b in bounds.items()]
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def enough(energy: str, macros: Sequence[str], least: int = 2) -> Column:
    """Whether energy is known, or `least` of the macros are."""
    return F.col(energy).isNotNull() | (sum((F.col(m).isNotNull().cast("int") for m in macros), F.lit(0)) >= least)


def all_liked_in(liked: Column, text: Column, longer: int = 2) -> Column:
    """Whether each liked name has a word (longer than this) in the text; true without likes."""
    low = F.lower(text)
    return F.coalesce(F.forall(liked, lambda n: F.exists(F.split(F.lower(n), " "), lambda w: (F.length(w) > longer) & low.contains(w))), F.lit(True))


def blocked(name: Column, patterns: Sequence[str], tokens: Sequence[str] = ()) -> Column:
    """Whether a name matches one of the patterns, or has one of the words."""
    test = F.lower(name).rlike("|".join(patterns)) if patterns else F.lit(False)
    return test | F.lower(name).rlike(r"\b(" + "|".join(tokens) + r")\b") if tokens else test


# --- shapes

def pivoted(df: DataFrame, key: str, name: str, names: Sequence[str], value: Column, how: Callable[[Column], Column]) -> DataFrame:
    """Long to wide in one aggregation, over the names given."""
    return df.groupBy(key).agg(*[how(F.when(F.col(name) == n, value)).alias(n) for n in names])


def first_value(value: Column, order: Column) -> Callable[[Column], Column]:
    """For `pivoted`: the value that comes first by `order`, whatever the order of rows."""
    return lambda test: F.min_by(value, F.when(test.isNotNull(), order))


def conflicts(df: DataFrame, name: str, unit: str) -> DataFrame:
    """Names with more than one unit, and these."""
    return df.groupBy(name).agg(F.array_sort(F.collect_set(unit)).alias("units")).where(F.size("units") > 1)


def guarded_pivot(df: DataFrame, key: str, name: str, unit: str, value: str, most: int = 200) -> DataFrame | None:
    """Sums, long to wide; None if there are too many names or one has several units."""
    names = [r[0] for r in df.select(name).where(F.col(name).isNotNull()).distinct().limit(most + 1).collect()]
    if len(names) > most or not conflicts(df, name, unit).isEmpty():
        return None
    return pivoted(df, key, name, sorted(names), F.col(value), F.sum).fillna(0)


def unpivoted(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Wide to long: key, name, value of values above 0."""
    return df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select(key, "x.*").where("value > 0")


def symmetric(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge in both directions, once."""
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.select(a, b, *rest).unionByName(edges.select(F.col(b).alias(a), F.col(a).alias(b), *rest)).distinct()


def nodes_of(*parts: tuple[DataFrame, str, str, str | None]) -> DataFrame:
    """Nodes (node_type, node_id, node_name) of frames (frame, type, id column, name column); of one id's names the first."""
    out = [f.select(F.lit(t).alias("node_type"), F.col(i).cast("string").alias("node_id"), F.col(n if n else i).cast("string").alias("node_name")) for f, t, i, n in parts]
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.groupBy("node_type", "node_id").agg(F.min("node_name").alias("node_name"))


# --- order and samples

def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(uniform(F.col(key), seed=seed), key)


def sampled(df: DataFrame, key: str, n: int, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """n rows without replacement, of the table or of each group."""
    draw = uniform(F.col(key), seed=seed)
    if not by:
        return df.orderBy(draw, key).limit(n)
    return df.withColumn("draw", F.row_number().over(Window.partitionBy(*by).orderBy(draw, key))).where(F.col("draw") <= n).drop("draw")


def oversampled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows: each as often as n allows, the rest drawn without replacement. Only copies are made, no pairs."""
    size = df.count()
    if not size:
        return df
    times, rest = divmod(n, size)
    some = df.orderBy(uniform(F.col(key), seed=seed), key).limit(rest)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("copy").unionByName(some) if times else some


def top_with_minimum(df: DataFrame, keys: Sequence[str], score: Column, passes: Column, k: int, least: int, tie: str) -> DataFrame:
    """Per group the k best that pass; if fewer than `least` do, filled up with the best of the others. Adds rank."""
    ranked = df.withColumn("passed", passes).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("passed"), score.desc(), F.col(tie))))
    n = ranked.where(F.col("rank") <= max(k, least))
    return n.where((F.col("passed") & (F.col("rank") <= k)) | (F.col("rank") <= least)).drop("passed")


def balanced(df: DataFrame, keys: Sequence[str], kind: str, n: int, tie: str, seed: int = 42) -> DataFrame:
    """Per group n rows: n div (number of kinds there) of each kind, then filled from what is left, all by hash."""
    draw = uniform(F.col(tie), seed=seed)
    each = df.withColumn("of_kind", F.row_number().over(Window.partitionBy(*keys, kind).orderBy(draw, tie))).where(F.col("of_kind") <= n)
    kinds = df.groupBy(*keys).agg(F.countDistinct(kind).alias("kinds"))
    over = F.when(F.col("of_kind") <= F.floor(F.lit(n) / F.col("kinds")), 0).otherwise(1)
    ranked = each.join(kinds, list(keys)).withColumn("chosen", F.row_number().over(Window.partitionBy(*keys).orderBy(over, draw, F.col(tie))))
    return ranked.where(F.col("chosen") <= n).drop("of_kind", "kinds", "chosen")


def drawn(weights: Mapping[str, float], *keys: Column, seed: int | str = 42) -> Column:
    """One of the values, by cumulative weights."""
    total, below, u, out = sum(weights.values()), 0.0, uniform(*keys, seed=seed), F.lit(list(weights)[-1])
    tests = []
    for value, w in weights.items():
        below += w / total
        tests.append((u < below, value))
    for test, value in reversed(tests[:-1]):
        out = F.when(test, F.lit(value)).otherwise(out)
    return out


def in_range(low: Column | float, high: Column | float, *keys: Column, seed: int | str = 42) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return lo + (hi - lo) * uniform(*keys, seed=seed)


def grid(spark: SparkSession, **options: Sequence) -> DataFrame:
    """All combinations of options, a row each."""
    return spark.createDataFrame(list(itertools.product(*options.values())), list(options))


def bootstrap(df: DataFrame, key: str, value: str, times: int = 1000, low: float = 0.025, high: float = 0.975, seed: int = 42) -> DataFrame:
    """Mean and percentile interval of it over resamples: each row counts in a resample as often as a Poisson draw says.

    A row makes its draws where it is, and only sums by resample are shuffled."""
    u = uniform(F.col(key), F.col("sample"), seed=seed)
    count, p, below = F.lit(0), 0.36787944117144233, 0.36787944117144233
    for k in range(1, 8):
        count = count + F.when(u >= below, 1).otherwise(0)
        p /= k
        below += p
    each = df.select(key, F.col(value).cast("double").alias("v"), F.explode(F.sequence(F.lit(1), F.lit(times))).alias("sample")).withColumn("times", count)
    means = each.groupBy("sample").agg((F.sum(F.col("v") * F.col("times")) / F.nullif(F.sum("times"), F.lit(0))).alias("m"))
    interval = means.agg(F.percentile("m", low).alias("low"), F.percentile("m", high).alias("high"))
    return df.agg(F.avg(value).alias("mean")).crossJoin(interval)
