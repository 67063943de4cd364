"""What the operators share: tables, scratch folder, bounded broadcasts, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Own only where it is unset and all runs in one place,
    as in tests; on a cluster an unset folder is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="platewise-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of what runs here go as soon as it ends, not when the driver's garbage is next collected."""
    before = spark.conf.get(name := "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def saved(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there and a lost executor loses nothing. The
    table replaces its shuffle files, which are removed."""
    spark = df.sparkSession
    with shuffles_removed(spark):
        df.write.option("compression", codec).parquet(path := new_path(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discarded(df: DataFrame) -> None:
    """Remove the files of a saved table that no plan reads any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._saved_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column, rest: int) -> Column:
    """Whether crc32(doc_id as text) mod 5 is rest; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == rest


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """body(value), value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_floor(counts: DataFrame, column: str, most: int, least: int = 1) -> int:
    """The smallest value v >= least such that at most `most` rows have column >= v (by a histogram, not a sort)."""
    total, floor = 0, None
    histogram = counts.where(F.col(column) >= least).groupBy(F.least(F.col(column), F.lit(1_000_000)).alias("v")).agg(F.count("*").alias("n"))
    for v, n in sorted(((r["v"], r["n"]) for r in histogram.collect()), reverse=True):
        if total + n > most:
            break
        total, floor = total + n, v
    return floor if floor is not None else 1 << 62


#: Nodes whose neighbours are dealt apart from the rest: at most so many, for each has that share of all edges.
HUBS = 1024


#: Edges that one task connects on its own: some 50 MB.
LOCAL = 1 << 20


def components(edges: DataFrame, name: str = "components", local: int = LOCAL) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component), the smallest id that can be reached.

    Up to `local` distinct edges are connected by one task. More go through alternating large-star and small-star steps,
    after each of which a task makes stars of what its own edges connect. Minima are partial aggregates; those of hubs (at most HUBS nodes with
    1 / HUBS of the edges each, and 64) are broadcast, so that a hub's neighbours stay where they are. Each round's table
    is written to the shared folder and the one before removed.
    """
    spark = edges.sparkSession

    def lowest(rows: DataFrame, total: int) -> DataFrame:
        """rows (a, b) and m, the smallest b of a."""
        low = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        floor = max(64, total // HUBS)
        hubs = low.where(F.col("n") > floor).select("a", "m").toArrow()
        if not hubs.num_rows:
            return rows.join(low.drop("n"), "a")
        hubs = F.broadcast(spark.createDataFrame(hubs))
        return rows.join(hubs, "a").unionByName(rows.join(hubs, "a", "left_anti").join(low.where(F.col("n") <= floor).drop("n"), "a"))

    def oriented(rows: DataFrame) -> DataFrame:
        return rows.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def stars(rows: DataFrame) -> DataFrame:
        return saved(rows.mapInArrow(lambda batches: contracted(batches, local), "a long, b long"), name)

    edges = saved(oriented(edges), name)
    while True:
        before, total = edges, edges.count()
        if total <= local:
            edges = stars(edges.coalesce(1))
            discarded(before)
            break
        parents = edges.select(F.col("b").alias("a")).distinct()
        if total == edges.select("a").distinct().count() and edges.join(parents, "a", "left_semi").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = lowest(both, 2 * total).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        small = lowest(large, total)
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = stars(oriented(small))
        discarded(before)
    nodes = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def contracted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b), some `most` at a time, as stars: each node with the smallest that these edges lead to."""

    def found(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        n = sum(map(len, held))
        ids, at = np.unique(np.concatenate([b.column(i).to_numpy() for i in range(2) for b in held]), return_inverse=True)
        u, v, top = at[:n], at[n:], np.arange(len(ids))
        while ((x := top[u]) != (y := top[v])).any():
            np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
            while (top[top] != top).any():
                top = top[top]
        below = np.flatnonzero(top != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[below]), pa.array(ids[top[below]])], ["a", "b"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= most:
            yield found(held)
            held, size = [], 0
    if size:
        yield found(held)


#: Rows of a table up to which it is broadcast; beyond, the join shuffles.
SMALL = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it is saved and has at most SMALL rows."""
    return F.broadcast(df) if df.count() <= SMALL else df


def constant(row: DataFrame) -> list[Column]:
    """The columns of a one-row table as literals: a subquery may not stand inside a higher-order function."""
    jvm, fields = row.sparkSession._jvm, row.schema.fields
    values = row._jdf.queryExecution().executedPlan().executeCollect()[0]
    out = []
    for i, field in enumerate(fields):
        kind = jvm.org.apache.spark.sql.types.DataType.fromJson(field.dataType.json())
        literal = jvm.org.apache.spark.sql.catalyst.expressions.Literal(values.getArray(i), kind)
        out.append(Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal)))
    return out


def without(docs: DataFrame, dropped: DataFrame, row: Column, small: int = SMALL) -> DataFrame:
    """docs without the rows whose (doc_id, row) the table dropped (doc_id, row) has; columns as given.

    A small table is broadcast. Otherwise rows that pass a bounded filter of its keys are joined by a shuffle, all others
    stay where they are."""
    a, b, c = fresh(docs, "dropped_id", "dropped_row", "row_key")
    dropped = dropped.select(F.col("doc_id").alias(a), F.col("row").alias(b))
    marked = docs.withColumn(c, row)
    same = F.col("doc_id").eqNullSafe(F.col(a)) & (F.col(c) == F.col(b))
    if dropped.count() <= small:
        return marked.join(F.broadcast(dropped), same, "left_anti").drop(c)
    bits = id_filter(dropped.select(F.xxhash64(a, b).alias("h")))
    words = constant(docs.sparkSession.createDataFrame(pa.table({"w": pa.array([bits.view(np.int64)], pa.list_(pa.int64()))})))[0]

    def inside(p: Column) -> Column:
        p = p.bitwiseAND(F.lit(64 * len(bits) - 1))
        return F.call_function("getbit", F.get(words, F.shiftrightunsigned(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1

    h = F.xxhash64("doc_id", c)
    maybe = inside(h) & inside(F.shiftrightunsigned(h, 32))
    return marked.where(~maybe).drop(c).unionByName(marked.where(maybe).join(dropped.hint("merge"), same, "left_anti").drop(c))


#: Bits of a filter of ids: 8 MB at most, whatever the number of ids.
FILTER = 1 << 26


def id_filter(hashes: DataFrame, bits: int = FILTER) -> np.ndarray:
    """Bits at the places of hashes (one long column, h): a Bloom filter of bounded size, put together by partial aggregates."""
    places = hashes.select(F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 32))).alias("p")).select(F.col("p").bitwiseAND(F.lit(bits - 1)).alias("p"))
    one = F.element_at(F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)]), F.col("p").bitwiseAND(F.lit(63)).cast("int") + 1)
    found = places.groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(F.bit_or(one).alias("v")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["w"].to_numpy()] = found["v"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def passes(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether hashes may be in the filter; those that are, pass."""
    h, mask = h.astype(np.int64).view(np.uint64), np.uint64(64 * len(filter_) - 1)
    hit = np.ones(len(h), bool)
    for p in (h & mask, (h >> np.uint64(32)) & mask):
        hit &= (filter_[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit
