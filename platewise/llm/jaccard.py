"""Similarity join by a blocked sparse matrix product of documents by word shingles.

Documents with equal sets form a class and go on as one; sets too small to link with another are left out. Shingles are
ordered from rare to frequent (the most frequent ones, a bounded table, by their counts; of the low hashes, which come
first among the rest, those that more than WIDE / 2 documents have stand behind, by a bounded filter of exact counts;
ties and the rest by hash: any one order gives right results). If two sets
share the required overlap t = ceil(0.9 n), their first n - t + k shingles share k. So only these few entries are
multiplied: entries of one shingle meet, size bounds discard pairs, counts accumulate, and pairs with less than k go.
A shingle with more than WIDE entries links them in a chain by size instead: any two of fitting sizes are joined by the
chain, so no candidate is lost, and what is emitted stays linear.
What is connected so far is a candidate block; exact overlaps of whole sets are then products of incidence matrices
within a block (see `links` for wide ones), and only a spanning forest of the true links is kept.

Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. With fewer words than a shingle the whole sequence is one. Null or
empty texts have no shingles and are linked with nothing. Rows are documents of their own, also if ids repeat: a class, not an
id, is what links, and its smallest id names it. A row without id has no component and links nothing. An empty table
gives no rows; other columns are ignored. Shingles, and classes, are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import components, count_floor, discarded, id_filter, passes, saved

FREQUENT, WIDE, PART, SHARED, PIVOTS = 1 << 18, 64, 512, 4, 8
#: Low hashes are dealt out by their next LANES bits; CELL bits more tell them apart when they are counted.
LANES, CELL = 10, 32
U = np.uint64


def shingles(text: str | None, words: int) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), U, len(parts))
    if not len(h):
        return h
    if len(h) < words:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), len(h))], U)
    out = np.zeros(len(h) - words + 1, U)
    for i in range(words):
        out = (out ^ h[i : len(h) - words + 1 + i]) * U(0x9E3779B97F4A7C15)
        out ^= out >> U(29)
        out = out * U(0xBF58476D1CE4E5B9) + U(i + 1)
        out ^= out >> U(32)
    return np.unique(out)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n with one that it is linked to."""
    return -(-n * percent // 100)


def low_bits(percent: int) -> int:
    """Leading zero bits of the low hashes: they are at least twice the share of a set that its prefix is."""
    return max(0, int(-math.log2(min(1, max(1e-3, 2 * (1 - percent / 100))))))


def places(h: np.ndarray, low: int) -> np.ndarray:
    """Low hashes as they are counted, mixed for the filter."""
    return (h >> U(64 - low - LANES - CELL)) * U(0x9E3779B97F4A7C15)


def frequent(docs: DataFrame, words: int, percent: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most `most` shingles that many documents have (ascending), their counts (single ones per MB are left out), and
    a filter of all low hashes that more than WIDE / 2 documents have.

    The low hashes go to their lane's task as 32-bit integers, many in one row, and are counted there, none left out."""
    low = low_bits(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, kept = [], 0, []

        def settle() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
            c = np.diff(np.append(at, len(h)))
            kept.append((h[at[c > 1]], c[c > 1]))
            h = h[: np.searchsorted(h, U(1 << (64 - low)))] if low else h
            cells = h >> U(64 - low - LANES - CELL)
            lanes, first = np.unique(cells >> U(CELL), return_index=True)
            cells = [x.astype(np.uint32).tobytes() for x in np.split(cells, first[1:])] if len(h) else []
            return pa.RecordBatch.from_pydict({"h": pa.nulls(len(lanes), pa.int64()), "n": pa.nulls(len(lanes), pa.int64()), "lane": pa.array(lanes.astype(np.int32)), "cells": pa.array(cells, pa.binary())})

        for batch in batches:
            for x in batch.column(0):
                held.append(s := shingles(x.as_py(), words))
                n += len(s)
                if n > 4_000_000:
                    yield settle()
                    held, n = [], 0
        if held:
            yield settle()
        if kept:
            h, at = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
            c = np.bincount(at, np.concatenate([c for _, c in kept]), len(h)).astype(np.int64)
            for i in range(0, len(h), 100_000):
                k = len(part := h[i : i + 100_000])
                yield pa.RecordBatch.from_pydict({"h": pa.array(part.view(np.int64)), "n": pa.array(c[i : i + 100_000]), "lane": pa.nulls(k, pa.int32()), "cells": pa.nulls(k, pa.binary())})

    def counted(lane: pa.Table) -> pa.Table:
        cells = np.sort(np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in lane["cells"]]))
        at = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        often = cells[at[np.diff(np.append(at, len(cells))) > WIDE // 2]].astype(U)
        return pa.table({"h": ((U(lane["lane"][0].as_py()) << U(CELL) | often) * U(0x9E3779B97F4A7C15)).view(np.int64)})

    met = saved(docs.select("text").mapInArrow(run, "h long, n long, lane int, cells binary"), "met")
    often = saved(met.where("lane IS NOT NULL").select("lane", "cells").groupBy("lane").applyInArrow(counted, "h long"), "low")
    counts = saved(met.where("lane IS NULL").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2"), "frequent")
    discarded(met)
    floor = count_floor(counts, "n", most, 3)
    top = counts.where(F.col("n") >= floor).toArrow()
    h, c = top["h"].to_numpy().astype(np.int64).view(U), top["n"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order], id_filter(often)


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row: doc_id, row (hash of the text), n, a 128-bit digest of the set (k1, k2), prefix (hashes)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, words, percent))
    low = low_bits(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        often, counts, wide = shared.value
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part = batch.slice(k, 1024)
                n, keys, prefixes = [], [], []
                for x in part.column(1):
                    s = shingles(x.as_py(), words)
                    n.append(len(s))
                    keys.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                    df = np.ones(len(s), np.int64)
                    if len(often):
                        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        df = np.where(often[at] == s, counts[at], 1)
                    k_low = int(np.searchsorted(s, U(1 << (64 - low)))) if low else len(s)
                    df[:k_low] = np.where(passes(wide, places(s[:k_low], low)), np.maximum(df[:k_low], WIDE), df[:k_low])
                    t = int(needed(np.array(len(s)), percent))
                    prefixes.append(s[np.lexsort((s, df))[: len(s) - t + min(SHARED, t)]].view(np.int64))
                keys = np.array(keys).reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "row": part.column(2), "n": pa.array(n, pa.int64()), "k1": pa.array(keys[:, 0]), "k2": pa.array(keys[:, 1]), "prefix": pa.array(prefixes, pa.list_(pa.int64()))})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(run, "doc_id long, row long, n long, k1 long, k2 long, prefix array<long>")


def entries_of(classes: DataFrame, percent: int, name: str = "k1") -> DataFrame:
    """Entries (token, doc, n) of the prefixes. A set of n links with another only if one of n + 1 that holds it would do."""
    able = classes.where(F.col("n") * 100 >= percent * (F.col("n") + 1))
    return able.select(F.explode("prefix").alias("token"), F.col(name).alias("doc"), "n")


def pairs_of(token: np.ndarray, doc: np.ndarray, n: np.ndarray, chained: bool, percent: int):
    """Pairs (a, b, weight) of whole groups of equal tokens, sorted by (token, n, doc). chained: chains only."""
    starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    sizes = np.diff(np.append(starts, len(token)))
    out = []
    wide = sizes > (1 if chained else WIDE)
    if wide.any():
        at = np.flatnonzero(np.repeat(wide, sizes))
        at = at[:-1][token[at[:-1]] == token[at[1:]]]
        out.append((at, at + 1, np.full(len(at), SHARED)))
    if not chained:
        for g in np.unique(sizes[(sizes > 1) & ~wide]):
            i, j = np.triu_indices(g, 1)
            s = starts[sizes == g][:, None]
            a, b = (s + i).ravel(), (s + j).ravel()
            out.append((a, b, np.ones(len(a), np.int64)))
    if not out:
        return [np.zeros(0, np.int64)] * 5
    a, b, w = (np.concatenate(x) for x in zip(*out, strict=True))
    fits = (n[a] >= needed(n[b], percent)) & (doc[a] != doc[b])
    a, b, w = a[fits], b[fits], w[fits]
    swap = doc[a] > doc[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    return [doc[a], doc[b], n[a], n[b], w]


def candidates(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of entries (token, doc, n) that share enough of their prefixes, or are neighbours in a chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chain = [np.zeros(0, np.int64)] * 3, None

        def batch_of(found) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], ["a", "b", "na", "nb", "w"])

        for batch in chained_end(batches):
            if batch is not None:
                held = [np.concatenate((h, batch.column(i).to_numpy())) for i, h in enumerate(held)]
                cut = first_of_last(held[0])
            else:
                cut = len(held[0])
            if chain is not None and len(held[0]):  # the first group goes on as a chain
                own = int(np.flatnonzero(held[0] != chain)[0]) if (held[0] != chain).any() else len(held[0])
                yield batch_of(pairs_of(*(h[:own] for h in held), True, percent))
                if own == len(held[0]) and batch is not None:
                    held = [h[-1:] for h in held]
                    continue
                held, cut, chain = [h[own:] for h in held], max(0, cut - own), None
            if cut:
                yield batch_of(pairs_of(*(h[:cut] for h in held), False, percent))
                held = [h[cut:] for h in held]
            if len(held[0]) > 64 * WIDE:
                chain = held[0][0]
                yield batch_of(pairs_of(*held, True, percent))
                held = [h[-1:] for h in held]

    met = entries.repartition("token").sortWithinPartitions("token", "n", "doc").select("token", "doc", "n").mapInArrow(run, "a long, b long, na long, nb long, w long")
    least = lambda n: F.least(F.lit(SHARED), F.expr(f"({n} * {percent} + 99) div 100"))
    return met.groupBy("a", "b").agg(F.sum("w").alias("w"), F.min("na").alias("na"), F.min("nb").alias("nb")).where(F.col("w") >= F.least(least("na"), least("nb"))).select("a", "b")


def chained_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches that have rows, then None."""
    for batch in batches:
        if len(batch):
            yield batch
    yield None


def first_of_last(token: np.ndarray) -> int:
    """Where the last group begins."""
    other = np.flatnonzero(token != token[-1])
    return int(other[-1]) + 1 if len(other) else 0


def forest(sets: list[np.ndarray], percent: int, columns: int = 4096) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets, from overlaps summed over blocks of columns."""
    n = np.array([len(s) for s in sets])
    token, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    new = np.concatenate(([True], token[1:] != token[:-1]))
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    keep = often[column]
    row, column = row[keep], (np.cumsum(often) - 1)[column[keep]]
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        lo, hi = np.searchsorted(column, [k, k + columns])
        block = np.zeros((len(sets), columns), np.float32)
        block[row[lo:hi], column[lo:hi] - k] = 1
        overlap += block @ block.T
    overlap = overlap.astype(np.int64)
    linked = 100 * overlap >= percent * (n[:, None] + n[None, :] - overlap)
    np.fill_diagonal(linked, False)
    seen, edges = np.zeros(len(sets), bool), []
    for start in range(len(sets)):
        if not seen[start]:
            seen[start], front = True, [start]
            while front:
                x = front.pop()
                for y in np.flatnonzero(linked[x] & ~seen).tolist():
                    seen[y] = True
                    edges.append((x, y))
                    front.append(y)
    return edges


def sets_of(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """members (id: the class, rep: a row that has it) and hashes, the class's set.

    Texts are hashed where they are; only rows that pass a filter of the members' ids go on to the join."""
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(members.select(F.xxhash64("rep").alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            at = np.flatnonzero(passes(shared.value, batch.column(2).to_numpy()))
            for k in range(0, len(at), 256):
                part = batch.take(pa.array(at[k : k + 256]))
                sets = [shingles(x.as_py(), words).tobytes() for x in part.column(1)]
                ids = [int(np.frombuffer(xxhash.xxh3_128_digest(s), np.int64)[0]) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["rep", "id", "hashes"])

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(run, "rep long, id long, hashes binary")
    return members.hint("merge").join(rows, ["id", "rep"])


def product_of(percent: int):
    """Of a group's rows (id, hashes): edges (a, b) of a forest of the links."""

    def product(group: pa.Table) -> pa.Table:
        ids = group["id"].to_numpy()
        _, first = np.unique(ids, return_index=True)  # a repeated row counts once
        sets = [np.frombuffer(group["hashes"][i].as_py(), U) for i in first.tolist()]
        edges = np.array(forest(sets, percent), np.int64).reshape(-1, 2)
        return pa.table({"a": ids[first][edges[:, 0]], "b": ids[first][edges[:, 1]]})

    return product


def links(docs: DataFrame, classes: DataFrame, blocks: DataFrame, words: int, percent: int) -> DataFrame:
    """True links (a, b) enough to connect what is linked within blocks (id, component).

    A block of at most PART classes is one product. A wider one is cut by size (sets that link lie in the same band of
    sizes or the next) and then into parts. First each part is multiplied with itself and with a few pivots of the bands
    about it. What that connects is mostly one large component of the block, its core; then only the classes outside the
    core are multiplied with all parts of their bands. No pair of different components is left out.
    """
    sizes = blocks.groupBy("component").agg(F.count("*").alias("size"))
    step = max(-math.log(percent / 100), 1e-9) * (1 + 1e-9)
    members = blocks.join(sizes, "component").join(classes.select(F.col("k1").alias("id"), "rep", "n"), "id")
    members = members.select("id", "rep", "component", (F.col("size") > PART).alias("wide"), F.floor(F.log(F.col("n").cast("double")) / step).cast("int").alias("band"))
    sets = saved(sets_of(docs, members, words), "sets")
    product, edge = product_of(percent), "a long, b long"
    found = saved(sets.where("NOT wide").select("component", "id", "hashes").groupBy("component").applyInArrow(product, edge), "narrow")
    wide = sets.where("wide").drop("rep", "wide")
    if wide.isEmpty():
        return found
    near = F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band")

    def dealt(rows: DataFrame, counts: DataFrame, out: str) -> DataFrame:
        """rows by the number (out) of a share of at most some PART of those of their (component, band)."""
        return rows.join(counts, ["component", "band"]).withColumn(out, F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")

    cells = saved(wide.groupBy("component", "band").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "cells")
    all_parts = cells.select("component", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    parts = saved(dealt(wide, cells, "part"), "parts")
    chosen = Window.partitionBy("component", "band").orderBy(F.xxhash64("id"), "id")
    pivots = parts.select("component", "band", "id").withColumn("r", F.row_number().over(chosen)).where(F.col("r") <= PIVOTS).select("id")
    pivots = parts.join(pivots, "id", "left_semi").select("component", near, "id", "hashes").join(all_parts, ["component", "band"])
    keys = ["component", "band", "part"]
    first = saved(parts.unionByName(pivots).groupBy(*keys).applyInArrow(product, edge), "first")
    label = saved(components(first, "first-links"), "labels")
    labelled = parts.select("component", "band", "id").join(label.select("id", F.col("component").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
    core = labelled.groupBy("component", "label").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("label", "n").alias("core"))
    rest = saved(labelled.join(core, "component").where("label <> core").select("component", "band", "id"), "rest")
    slices = saved(rest.groupBy("component", "band").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "slices")
    own = parts.join(rest.select("id"), "id", "left_semi").drop("part")
    own = dealt(own, slices, "slice").withColumnRenamed("band", "of").select("component", "of", "slice", "id", "hashes", F.explode(F.sequence(F.col("of") - 1, F.col("of") + 1)).alias("band")).join(all_parts, ["component", "band"])
    all_slices = slices.select("component", F.col("band").alias("of"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slice"), near)
    against = parts.join(all_slices, ["component", "band"])
    keys = ["component", "band", "part", "of", "slice"]
    second = own.select(*keys, "id", "hashes").unionByName(against.select(*keys, "id", "hashes")).groupBy(*keys).applyInArrow(product, edge)
    return found.unionByName(first).unionByName(saved(second, "second"))


def joined(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, row (hash of the text), component (a key: where ids repeat, two
    components may have one smallest id)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    found = saved(signatures(docs, words, percent), "signatures")
    classes = saved(found.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix")), "classes")
    blocks = saved(components(candidates(entries_of(classes, percent), percent), "blocks"), "blocks")
    linked = components(links(docs, classes, blocks, words, percent), "links")
    named = saved(classes.select(F.col("k1").alias("id"), "rep").join(linked, "id"), "named")
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(lowest, "component").select(F.col("id").alias("k1"), "component", "component_id")
    of_class = classes.select("k1", "k2", "n", "rep").join(named, "k1", "left").select("k1", "k2", "n", F.coalesce("component", "k1").alias("component"), F.coalesce("component_id", "rep").alias("component_id"))
    rows = found.select("doc_id", "row", "n", "k1", "k2").join(of_class, ["k1", "k2", "n"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "row", "component")
