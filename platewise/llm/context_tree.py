"""Language-model scores by context-tree weighting over bytes.

A text is its words (A-Z lower-cased) joined by spaces and an end. Each byte is eight binary decisions; for each
decision, Krichevsky-Trofimov estimates of all context depths (0 to DEPTH bytes) are mixed by the context-tree weights
of the training data: half for the node as a leaf, half for its children. Trees depend on counts alone, so training is
one distributed count of byte sequences. A context is opened if training has it OPEN times, at every size of the
corpus; what its unopened children saw is pooled in one leaf.

The tree is never in one place. Sequences are dealt by the last LOW bytes of their contexts, so that a context meets
all longer ones in one task: a first pass weighs these subtrees up to their roots, the driver weighs the 257 contexts
above them (a constant size), a second pass mixes down and gives the log probability of each sequence. Texts are in
groups of some GROUP bytes; a group is joined with its distinct sequences alone, and the code length of a text is a
sum over its bytes.

The base is a smoothed unigram model of whole words. The counts of a bounded number of frequent words are broadcast,
rarer words of a document are joined with theirs.

Null text counts as empty: one end token. Repeated rows are scored alike and count as often as they stand. Without
training rows every byte has probability 1/256. Words are compared by 64-bit hashes. An empty table gives no rows; other
columns are ignored, ids may be null or repeat.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import count_floor, discarded, held_out, saved, shuffles_removed

DEPTH, OPEN, FREQUENT = 5, 2, 1 << 18
END, CHUNK = 10, 4_000_000
#: Bytes of text that are scored together; distinct sequences that are weighed in one task.
GROUP, PART = 16_000_000, 1_000_000
LOW = 2
#: Of tables in the shared folder: texts and sorted sequences take about half of what faster codecs leave.
CODEC = "zstd"


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def stream(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, each after DEPTH ends and with one at its end; where each text begins."""
    texts = [bytes([END]) * DEPTH + b" ".join(w) + bytes([END]) for w in words]
    ends = np.cumsum([len(t) for t in texts])
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], ends[:-1]))


def coded(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The places of bytes that are coded: all but what is put before a text."""
    mark = np.ones(len(raw), bool)
    for k in range(DEPTH):
        mark[starts + k] = False
    return np.flatnonzero(mark)


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and their counts, as one such pair."""
    keys, counts = (np.concatenate([x[i] for x in held]) for i in range(2))
    if not len(keys):
        return [(keys, counts)]
    order = np.argsort(keys, kind="stable")  # a merge, as runs are sorted
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return [(keys[first], np.add.reduceat(counts[order], first))]


def sequences(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The DEPTH + 1 bytes that end at each place, the last byte lowest."""
    key = raw[at - DEPTH].astype(np.int64)
    for k in range(DEPTH - 1, -1, -1):
        key = key << 8 | raw[at - k]
    return key


def grouped(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, held_out) with their group: of texts of one task in a row, of some GROUP bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = size + np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            size = int(sizes[-1]) if len(sizes) else size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(task + sizes // GROUP)], ["doc_id", "text", "held_out", "group"])

    return saved(docs.mapInArrow(run, "doc_id long, text string, held_out boolean, group long"), "texts", CODEC)


def counted(docs: DataFrame) -> DataFrame:
    """Counts in the texts that are not held out: (kind 0, hash of a word), (kind 2, 0) for texts; by group, of all texts,
    (kind 1, DEPTH + 1 bytes in a row), with a count of 0 for those that only held-out texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held: list[list] = [[], []]
        words: list[list] = [[], []]
        group, size, texts = None, 0, 0

        def rows(kind: int, of: int) -> Iterator[pa.RecordBatch]:
            keys, counts = summed(held[kind])[0] if held[kind] else ([], [])
            held[kind] = []
            for i in range(0, len(keys), 100_000):
                part = keys[i : i + 100_000].view(np.int64)
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(part), kind, np.int32)), "group": pa.array(np.full(len(part), of)), "key": pa.array(part), "n": pa.array(counts[i : i + 100_000])})

        def settle() -> None:
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for x in words[0] for w in x), np.uint64)
            held[0].append(np.unique(hashes, return_counts=True))
            for out in range(2):
                if words[out]:
                    raw, starts = stream(words[out])
                    keys, counts = np.unique(sequences(raw, coded(raw, starts)), return_counts=True)
                    held[1].append((keys, counts * (1 - out)))
                words[out] = []
            for k in range(2):
                if len(held[k]) >= 4:
                    held[k] = summed(held[k])

        for batch in batches:
            for x, out, g in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if size and (size > CHUNK or g != group):
                    settle()
                    size = 0
                if g != group:
                    yield from rows(1, group)
                    group = g
                words[out].append(tokens(x.as_py()))
                size += sum(map(len, words[out][-1])) + 1
                texts += not out
        if size:
            settle()
        yield from rows(1, group)
        yield from rows(0, 0)
        if texts:
            yield pa.RecordBatch.from_pydict({"kind": pa.array([2], pa.int32()), "group": pa.array([0], pa.int64()), "key": pa.array([0], pa.int64()), "n": pa.array([texts], pa.int64())})

    return docs.select("text", "held_out", "group").mapInArrow(run, "kind int, group long, key long, n long")


def lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 7, and the recurrence back; x >= 1/2."""
    down = np.ones_like(x)
    for k in range(7):
        down *= x + k
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(down)


def kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log probability of a sequence with a zeros and b ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - math.log(math.pi)


class Tree:
    """The tree in one place, for small counts; the passes over its parts (`weighed`, `Top`) give the same.

    contexts[d]: the opened contexts of d bytes (ascending; the last byte lowest); counts[d]: of the bytes after them."""

    def __init__(self, contexts: list[np.ndarray], counts: list[np.ndarray]):
        self.children, self.offsets = [], np.concatenate(([0], np.cumsum([len(c) for c in contexts])))
        parents = [None]
        for d in range(1, DEPTH + 1):
            parent = np.searchsorted(contexts[d - 1], contexts[d] & ((1 << (8 * (d - 1))) - 1))
            parents.append(parent)
            # row 0: not open; a row for each context of d - 1 bytes, by the byte before it: 1 + the place of the child
            child = np.zeros((len(contexts[d - 1]) + 1, 256), np.int32)
            child[parent + 1, contexts[d] >> (8 * (d - 1))] = np.arange(1, len(contexts[d]) + 1)
            self.children.append(child)
        rest = []
        for d in range(DEPTH):
            left = counts[d].copy()
            np.subtract.at(left, parents[d + 1], counts[d + 1])
            rest.append(left)
        logs = [np.zeros((len(c), 256), np.float32) for c in contexts]
        for level in range(8):
            shape = (-1, 1 << level, 2, 1 << (7 - level))
            split = [c.reshape(shape).sum(-1, dtype=np.float64) for c in counts]
            pooled = [c.reshape(shape).sum(-1, dtype=np.float64) for c in rest]
            leaf = [kt(s[..., 0], s[..., 1]) for s in split]
            whole, weight = leaf[DEPTH], [None] * DEPTH
            for d in range(DEPTH - 1, -1, -1):
                below = kt(pooled[d][..., 0], pooled[d][..., 1])
                np.add.at(below, parents[d + 1], whole)
                whole = np.logaddexp(leaf[d], below) - math.log(2)
                weight[d] = np.exp(leaf[d] - math.log(2) - whole)
            one = lambda s: (s[..., 1] + 0.5) / (s[..., 0] + s[..., 1] + 1)
            mixed, left = np.zeros((1, 1 << level)), np.ones((1, 1 << level))
            for d in range(DEPTH + 1):
                own = one(split[d])
                p = mixed + left * (own if d == DEPTH else weight[d] * own + (1 - weight[d]) * one(pooled[d]))
                logs[d].reshape(shape)[...] += np.log(np.stack([1 - p, p], -1))[..., None]
                if d < DEPTH:
                    mixed, left = (mixed + left * weight[d] * own)[parents[d + 1]], (left * (1 - weight[d]))[parents[d + 1]]
        self.logs = np.concatenate(logs)

    @staticmethod
    def scores(children: list[np.ndarray], offsets: np.ndarray, logs: np.ndarray, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log (base 10) probability of each text."""
        at = coded(raw, starts)
        place = np.ones(len(at), np.int32)
        state = np.zeros(len(at), np.int32)
        for d in range(1, DEPTH + 1):
            place = children[d - 1][place, raw[at - d]]
            state = np.where(place > 0, offsets[d] + place - 1, state)
        values = logs[state, raw[at]].astype(np.float64)
        first = np.searchsorted(at, starts)
        return np.add.reduceat(values, first) / math.log(10)


def one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b + 0.5) / (a + b + 1)


class Top:
    """The contexts of 0 and 1 bytes. Node: 256 * the byte of the context + the path, 1 and the bits so far.

    a, b: zeros and ones at each node; oa, ob: those in opened contexts of LOW bytes; below: log probabilities of these."""

    def __init__(self, a: np.ndarray, b: np.ndarray, oa: np.ndarray, ob: np.ndarray, below: np.ndarray):
        a, b, oa, ob, below = (x.reshape(256, 256) for x in (a, b, oa, ob, below))
        live = a[:, 1] + b[:, 1] >= OPEN

        def weigh(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, ...]:
            leaf = kt(a, b)
            whole = np.logaddexp(leaf, kt(ra, rb) + below) - math.log(2)
            return whole, np.exp(leaf - math.log(2) - whole), one(a, b), one(ra, rb)

        whole, weight, own, rest = weigh(a, b, a - oa, b - ob, below)
        a0, b0 = a.sum(0), b.sum(0)
        _, weight0, own0, rest0 = weigh(a0, b0, a0 - a[live].sum(0), b0 - b[live].sum(0), whole[live].sum(0))
        mixed, left = weight0 * own0, 1 - weight0
        p = np.where(live[:, None], mixed + left * (weight * own + (1 - weight) * rest), mixed + left * rest0)
        self.mixed, self.left = (mixed + left * weight * own).ravel(), (left * (1 - weight)).ravel()
        logs, byte = np.zeros((256, 256)), np.arange(256)
        for level in range(8):
            q = p[:, 1 << level | byte >> (8 - level)]
            logs += np.log(np.where(byte >> (7 - level) & 1, q, 1 - q))
        self.logs = logs.ravel()


def weighed(keys: np.ndarray, n: np.ndarray, top: Top | None) -> np.ndarray:
    """Of sequences and their counts, with all that share the last LOW bytes of the context: the log probability of each
    one's last byte, or without `top`, the arrays that it is made of."""
    depths = range(LOW, DEPTH + 1)
    pairs, of, up, counts, opened = {}, {}, {}, {}, {}  # by depth; a pair is a context and the byte after it
    for d in depths:
        pairs[d], first, of[d] = np.unique(keys & ((1 << (8 * d + 8)) - 1), return_index=True, return_inverse=True)
        counts[d] = np.bincount(of[d], n)
        context = np.cumsum(np.r_[True, np.diff(pairs[d] >> 8) != 0]) - 1
        opened[d] = np.bincount(context, counts[d])[context] >= OPEN
        if d > LOW:
            up[d] = of[d - 1][first]
    sums = np.zeros((5, 1 << 16))
    logs = {d: np.zeros(len(pairs[d])) for d in depths}
    for level in range(8):
        node, first, bit, a, b, live, parent, ra, rb, weight = ({} for _ in range(10))
        for d in depths:
            ids = pairs[d] >> (8 - level)
            start = np.r_[True, ids[1:] != ids[:-1]]
            node[d], first[d] = np.cumsum(start) - 1, np.flatnonzero(start)
            bit[d] = pairs[d] >> (7 - level) & 1
            b[d] = np.bincount(node[d], counts[d] * bit[d])
            a[d] = np.bincount(node[d], counts[d]) - b[d]
            live[d] = opened[d][first[d]]
            if d > LOW:
                parent[d] = node[d - 1][up[d][first[d]]]
        whole = kt(a[DEPTH], b[DEPTH])
        for d in range(DEPTH - 1, LOW - 1, -1):
            on, size = live[d + 1], len(a[d])
            at = parent[d + 1][on]
            ra[d], rb[d] = a[d] - np.bincount(at, a[d + 1][on], size), b[d] - np.bincount(at, b[d + 1][on], size)
            leaf = kt(a[d], b[d])
            whole = np.logaddexp(leaf, kt(ra[d], rb[d]) + np.bincount(at, whole[on], size)) - math.log(2)
            weight[d] = np.exp(leaf - math.log(2) - whole)
        ids = pairs[LOW][first[LOW]] >> (8 - level)
        above = (ids >> level & 255) << 8 | 1 << level | ids & ((1 << level) - 1)
        if top is None:
            on = live[LOW]
            for k, x in enumerate((a[LOW], b[LOW], a[LOW] * on, b[LOW] * on, whole * on)):
                sums[k] += np.bincount(above, x, 1 << 16)
            continue
        mixed, left = top.mixed[above], top.left[above]
        for d in depths:
            own = one(a[d], b[d])
            p = (mixed + left * (own if d == DEPTH else weight[d] * own + (1 - weight[d]) * one(ra[d], rb[d])))[node[d]]
            logs[d] += np.log(np.where(bit[d], p, 1 - p))
            if d < DEPTH:
                mixed, left = (mixed + left * weight[d] * own)[parent[d + 1]], (left * (1 - weight[d]))[parent[d + 1]]
    if top is None:
        return sums
    values = top.logs[keys & 0xFFFF]
    for d in depths:
        values = np.where(opened[d][of[d]], logs[d][of[d]], values)
    return values


def sequence_logs(grams: DataFrame) -> DataFrame:
    """key, log: the log probability of the last byte of each sequence, by the tree of the counts (key, n)."""
    context = grams.sparkSession.sparkContext
    parts = max(context.defaultParallelism, grams.count() // PART + 1)
    dealt = grams.select("key", "n").repartition(parts, F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << 8 * LOW) - 1)))

    def own(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        return tuple(np.concatenate([x[k] for x in held]) if held else np.zeros(0, np.int64) for k in range(2))

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = own(batches)
        if len(keys):
            sums = weighed(keys, n, None)
            at = np.flatnonzero(sums[0] + sums[1])
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(x[at]) for x in sums]], ["node", *"abcde"])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = own(batches)
        if len(keys):
            values = weighed(keys, n, shared.value)
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000]), pa.array(values[i : i + 100_000].astype(np.float32))], ["key", "log"])

    sums = np.zeros((5, 1 << 16))
    with shuffles_removed(grams.sparkSession):
        nodes = dealt.mapInArrow(up, "node long, a double, b double, c double, d double, e double").groupBy("node").agg(*[F.sum(x).alias(x) for x in "abcde"]).toArrow()
    sums[:, nodes["node"].to_numpy()] = [nodes[x].to_numpy() for x in "abcde"]
    shared = context.broadcast(Top(*sums))
    return saved(dealt.mapInArrow(down, "key long, log float"), "logs", CODEC)


def scored(docs: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (code length). Learns from rows not held out."""
    spark = docs.sparkSession
    docs = grouped(docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id"), 1).alias("held_out")))
    counts = saved(counted(docs), "counts", CODEC)
    words = saved(counts.where("kind = 0").groupBy(F.col("key").alias("h")).agg(F.sum("n").alias("c")), "words")
    texts = counts.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    n, v = words.agg(F.sum("c"), F.count("*")).first()
    n, v = (n or 0) + texts, v + (texts > 0)
    met = counts.where("kind = 1").select("group", "key")
    grams = saved(counts.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")), "sequences", CODEC)
    logs = sequence_logs(grams)
    discarded(grams)
    values = saved(met.join(logs, "key").select("group", "key", "log"), "values", CODEC)
    discarded(counts)
    discarded(logs)
    floor = count_floor(words, "c", frequent, 2)
    top = words.where(F.col("c") >= floor).toArrow()
    h, c = top["h"].to_numpy().astype(np.int64).view(np.uint64), top["c"].to_numpy()
    order = np.argsort(h)
    shared = spark.sparkContext.broadcast((h[order], c[order]))
    end = math.log10(texts + 0.5)

    def run(texts_of: pa.Table, known_logs: pa.Table) -> pa.Table:
        import pandas as pd
        import xxhash

        (often, counts), out = shared.value, []
        found, log = np.unique(known_logs["key"].to_numpy(), return_index=True)
        sequence, log = pd.Index(found), known_logs["log"].to_numpy()[log]
        for batch in texts_of.to_batches():
            ids, texts_, held, k = batch.column(0), batch.column(1), batch.column(2), 0
            while k < len(batch):
                words, size, first = [], 0, k
                while k < len(batch) and size < CHUNK // 2 and k - first < 2048:
                    words.append(tokens(texts_[k].as_py()))
                    size += sum(map(len, words[-1])) + 1
                    k += 1
                raw, starts = stream(words)
                at = coded(raw, starts)
                place = sequence.get_indexer(sequences(raw, at))
                scores = np.add.reduceat(log[place].astype(np.float64), np.searchsorted(at, starts)) / math.log(10)
                sizes = np.array([len(w) for w in words])
                h = np.fromiter((xxhash.xxh3_64_intdigest(w) for x in words for w in x), np.uint64, int(sizes.sum()))
                doc = np.repeat(np.arange(len(words)), sizes)
                at = np.minimum(np.searchsorted(often, h), max(len(often) - 1, 0))
                hit = often[at] == h if len(often) else np.zeros(len(h), bool)
                known = np.bincount(doc[hit], minlength=len(words))
                base = np.bincount(doc[hit], np.log10(counts[at[hit]] + 0.5), len(words)) if hit.any() else np.zeros(len(words))
                cuts = np.searchsorted(doc[~hit], np.arange(1, len(words)))
                rare = [np.unique(x, return_counts=True) for x in np.split(h[~hit], cuts)]
                out.append(pa.RecordBatch.from_arrays(
                    [ids.slice(first, k - first).cast(pa.int64()), held.slice(first, k - first), pa.array(sizes + 1), pa.array(np.diff(np.append(starts, len(raw))) - DEPTH), pa.array(known + (texts > 0)), pa.array(base + end), pa.array(scores), pa.array([x.view(np.int64) for x, _ in rare], pa.list_(pa.int64())), pa.array([c.astype(np.int32) for _, c in rare], pa.list_(pa.int32()))],
                    ["doc_id", "held_out", "n_tokens", "n_bytes", "known", "base", "score", "rare", "times"],
                ))
        return pa.Table.from_batches(out)

    rows = docs.groupBy("group").cogroup(values.groupBy("group")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_bytes long, known long, base double, score double, rare array<long>, times array<int>")
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "scores", CODEC)
    discarded(docs)
    discarded(values)
    rare = rows.select("row", F.inline(F.arrays_zip(F.col("rare").alias("h"), F.col("times").alias("t"))))
    found = rare.join(words, "h", "left").groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("t")).otherwise(0)).alias("more"), F.sum(F.col("t") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"))
    below = math.log10(n + 0.5 * (v + 1))
    return rows.drop("rare", "times").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * below).alias("base_score"), "score",
        (F.col("score") * -math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )
