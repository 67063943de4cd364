"""Benchmark decontamination by SimHash windows, by Spark expressions alone.

Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; shingles are five words (an item with fewer is one shingle). A
window is as long as an item; a document with fewer shingles than the item is one window. A window of m shingles that
reaches the similarity to an item of n shares at least 4/9 (for 0.8) of n + m with it, so only windows with so many
shingles of items of that size are fingerprinted: none is lost.
Fingerprints are 64-bit SimHashes, summed in packed 16-bit lanes. Items' fingerprints are indexed in 8 blocks, each
under all values within radius // 8 bits: any two within the radius meet in some block. Pairs that meet and are
within the radius are verified by the weighted (multiset) Jaccard similarity of their shingles.

Null text counts as empty; empty texts and items match nothing. Rows of equal id and text are one document. An empty
table, or benchmark, gives no rows. Other columns are ignored, and kept by `decontaminated` whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import SPACE, ascii_lower, let, saved, small, without

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 23, 8


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def hashes(w: Column, width: int) -> Column:
    """The hash of the `width` words from each place."""
    none = F.array().cast("array<long>")
    return let(w, lambda v: F.when(F.size(v) < width, none).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(v, i + k) for k in range(width)]))))


def fingerprints(windows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and simhash of rows with keys and hashes: bit i is set if more than half of the hashes have it."""
    lanes = 0x0001000100010001
    each = windows.select(*keys, F.size("hashes").alias("all"), F.explode("hashes").alias("h"))
    sums = each.groupBy(*keys).agg(F.first("all").alias("all"), *[F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(lanes))).alias(f"s{k}") for k in range(16)])
    bits = F.lit(0).cast("long")
    for k in range(16):
        for lane in range(4):
            ones = F.shiftrightunsigned(f"s{k}", 16 * lane).bitwiseAND(F.lit(0xFFFF))
            bits = bits.bitwiseOR(F.when(ones * 2 > F.col("all"), F.lit((1 << (16 * lane + k)) - (1 << 64 if 16 * lane + k == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, bits.alias("simhash"))


def blocks(simhash: Column, near: int = 0) -> Column:
    """(block, value) of the fingerprint's blocks, and of all values up to `near` bits from them."""
    width = 64 // BLOCKS
    masks = [sum(1 << b for b in c) for r in range(near + 1) for c in combinations(range(width), r)]

    def block(b: int) -> Column:
        value = F.shiftrightunsigned(simhash, b * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        return F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.struct(F.lit(b).alias("block"), value.bitwiseXOR(m).alias("value")))

    return F.flatten(F.array(*[block(b) for b in range(BLOCKS)]))


def overlap(a: Column, b: Column) -> Column:
    """How many elements two multisets share."""
    # a pair of window and item is met a few times only, so the plain count is enough
    many = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return F.when(F.size(F.array_distinct(a)) == F.size(a), F.size(F.array_intersect(a, b))).otherwise(many)


def leaks_of(docs: DataFrame, items: DataFrame, width: int, percent: int, radius: int) -> DataFrame:
    """Leaks of items (item_id, n, hashes) whose shingles are `width` words."""
    sizes = saved(items.select(F.explode("hashes").alias("h"), "n").distinct(), "item-shingles")
    shingled = docs.select("doc_id", F.xxhash64("text").alias("row"), hashes(words(F.col("text")), width).alias("all"))
    shingled = shingled.select("doc_id", "row", "all", F.size("all").alias("m"))
    marked = shingled.select("doc_id", "row", "m", F.posexplode("all").alias("at", "h")).join(small(sizes), "h")
    least = F.expr(f"({percent} * (n + least(m, n)) + {99 + percent}) div {100 + percent}")  # the least overlap of an item and a window
    hits = marked.groupBy("doc_id", "row", "n").agg(F.first("m").alias("m"), F.array_sort(F.collect_set("at")).alias("at")).withColumn("c", least.cast("int")).where(F.size("at") >= F.col("c"))

    def starts(at: Column, n: Column, c: Column) -> Column:
        """Places from which n shingles hold at least c of the places `at`: for each first place in the window, a range."""
        def from_first(x: Column, i: Column) -> Column:
            lo = F.greatest(F.coalesce(F.get(at, i - 1) + 1, F.lit(0)), F.get(at, i + c - 1) - n + 1, F.lit(0))
            return F.when(F.get(at, i + c - 1).isNotNull() & (lo <= x), F.sequence(lo, F.greatest(x, lo))).otherwise(F.array().cast("array<int>"))

        return F.flatten(F.transform(at, from_first))

    places = F.when(F.col("m") < F.col("n"), F.array(F.lit(0))).otherwise(starts(F.col("at"), F.col("n"), F.col("c")))
    spots = saved(hits.select("doc_id", "row", F.col("n").alias("n"), places.alias("starts")).where(F.size("starts") > 0), "spots")
    asked = small(spots.select(F.col("doc_id").alias("_a"), F.col("row").alias("_b")).distinct())
    whole = docs.select(F.col("doc_id").alias("_id"), "text", F.xxhash64("text").alias("_row")).join(asked, F.col("_id").eqNullSafe(F.col("_a")) & (F.col("_row") == F.col("_b")), "left_semi")
    whole = whole.dropDuplicates(["_id", "_row"]).select("_id", "_row", hashes(words(F.col("text")), width).alias("all"))
    opened = spots.join(whole, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")))
    windows = opened.select("doc_id", "row", "n", "all", F.explode("starts").alias("start")).where((F.col("start") == 0) | (F.col("start") + F.col("n") <= F.size("all")))
    windows = windows.select("doc_id", "row", "n", "start", F.slice("all", F.col("start") + 1, F.col("n")).alias("hashes"))
    windows = saved(windows.withColumn("window", F.xxhash64("hashes")), "windows")
    # a passage that many documents have is one window: it is fingerprinted, met and verified once
    each = windows.select("n", "window", "hashes").groupBy("n", "window").agg(F.first("hashes").alias("hashes"))
    each, keys = saved(each, "distinct-windows"), ["n", "window"]
    prints = fingerprints(each, keys)
    index = fingerprints(items, ["item_id", "n"]).select("item_id", "n", F.col("simhash").alias("s"), F.inline(blocks(F.col("simhash"), radius // BLOCKS)))
    met = prints.select(*keys, "simhash", F.inline(blocks(F.col("simhash")))).join(index, ["n", "block", "value"])
    near = met.where(F.bit_count(F.col("simhash").bitwiseXOR(F.col("s"))) <= radius).select(*keys, "item_id").distinct()
    both = near.join(each, keys).join(items.select("item_id", F.col("hashes").alias("own")), "item_id")
    shared = overlap(F.col("hashes"), F.col("own"))
    similar = both.select(*keys, "item_id", F.size("hashes").alias("m"), (shared / (F.col("n") + F.size("hashes") - shared)).alias("similarity")).where(F.col("similarity") * 100 >= percent - 1e-9)
    placed = windows.select("doc_id", "row", "start", *keys).join(small(saved(similar, "similar")), keys)
    best = F.max_by(F.struct("start", "similarity", "m"), F.struct("similarity", -F.col("start")))
    return placed.groupBy("doc_id", "row", "item_id").agg(best.alias("b")).select("doc_id", "row", "item_id", "b.start", (F.col("b.m") + width - 1).alias("n_words"), "b.similarity")


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, radius: int = RADIUS, least_words: int = 1) -> DataFrame:
    """Per document and item it holds: doc_id, row (hash of the text), item_id, start and n_words (of the best window), similarity.

    Items of fewer than `least_words` words are left out: a benchmark text of one word is in no document by leak."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    said = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") >= max(1, least_words)).dropDuplicates(["item_id", "w"])
    out = None
    for width in [r["k"] for r in said.select(F.least(F.size("w"), F.lit(SHINGLE)).alias("k")).distinct().orderBy("k").collect()]:
        own = said.where(F.least(F.size("w"), F.lit(SHINGLE)) == width).select("item_id", hashes(F.col("w"), width).alias("hashes"))
        own = saved(own.select("item_id", F.size("hashes").alias("n"), "hashes"), "items")
        found = leaks_of(docs, own, width, percent, radius)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, row long, item_id long, start int, n_words int, similarity double")


def decontaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = 1) -> DataFrame:
    """docs without those that hold an item of at least `least_words` words; columns as given."""
    found = saved(leaks(docs, benchmark, least_words=least_words).select("doc_id", "row").distinct(), "leaks")
    return without(docs, found, F.xxhash64(F.coalesce("text", F.lit(""))))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The leaks: doc_id, item_id, start, n_words, similarity."""
    return leaks(docs, benchmark).select("doc_id", "item_id", "start", "n_words", F.round("similarity", 6).alias("similarity"))
