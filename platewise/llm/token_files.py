"""Token ids in files, compressed by Re-Pair.

Texts are encoded by the tokenizers library (each distinct word once in a while, for merges never cross words), an end
id follows each, and ids are written in ascending order of doc_id
(null first, ties by the text's hash): documents are dealt into ranges of ids, each range a shard. Within blocks of a
shard, frequent pairs of ids are replaced, round after round, by new symbols; a block stores its rules (pairs), the
lengths their symbols expand to, the remaining sequence and where each document starts, so that a document is decoded
by finding its first symbol in the running sum of lengths and expanding from there.

Null text counts as empty and gives the end id alone. Repeated rows are written each; an empty table gives no files.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import new_path, saved, small

END, BLOCK, ROUNDS, PAIRS, LEAST = 0, 1_000_000, 5, 2048, 24
#: Words of which a worker process keeps the ids (some 100 MB).
ROOM = 600_000
#: How a byte-level vocabulary writes the bytes of a space and a line feed.
SIGNS = ("\u0120", "\u010a")


def replaced(ids: np.ndarray, rounds: int = ROUNDS, most: int = PAIRS, least: int = LEAST, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, rules): each round the most frequent pairs that share no id become symbols first + i."""
    seq, rules = ids.astype(np.int64), []
    first = int(seq.max(initial=0)) + 1 if first is None else first
    for _ in range(rounds):
        if len(seq) < 2 * least:
            break
        keys = np.sort((seq[:-1] << 32) | seq[1:])
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        counts = np.diff(np.append(starts, len(keys)))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        often = often[np.argsort(-counts[often], kind="stable")][: 4 * most]
        size = first + len(rules)
        symbol, left, right = np.full(size, -1, np.int64), np.zeros(size, bool), np.zeros(size, bool)
        partner, new = np.full(size, -1, np.int64), []
        for key in keys[starts[often]].tolist():
            a, b = key >> 32, key & 0xFFFFFFFF
            # a starts one pair at most and ends none, so that replacements cannot overlap
            if a == b or left[a] or right[a] or left[b]:
                continue
            left[a], right[b], partner[a], symbol[a] = True, True, b, size + len(new)
            new.append((a, b))
            if len(new) == most:
                break
        at = np.flatnonzero(partner[seq[:-1]] == seq[1:])
        seq[at] = symbol[seq[at]]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules += new
    return seq, np.array(rules, np.int64).reshape(-1, 2)


def expansions(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each of the rules' symbols stands for."""
    lengths = np.ones(first + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        lengths[first + i] = lengths[a] + lengths[b]
    return lengths


class Block:
    """One block: `raw` is its bytes."""

    @staticmethod
    def packed(ids: np.ndarray) -> bytes:
        first = int(ids.max(initial=0)) + 1
        seq, rules = replaced(ids, first=first)
        lengths = expansions(rules, first)
        kind = "<u2" if first + len(rules) <= 65536 else "<u4"
        head = np.array([first, len(rules), len(seq), 2 if kind == "<u2" else 4], "<u8").tobytes()
        return head + rules.astype("<u4").tobytes() + lengths[first:].astype("<u4").tobytes() + seq.astype(kind).tobytes()

    def __init__(self, raw: bytes):
        self.first, n, m, width = np.frombuffer(raw, "<u8", 4).tolist()
        at = 32
        self.rules = np.frombuffer(raw, "<u4", 2 * n, at).reshape(-1, 2).astype(np.int64)
        self.lengths = np.concatenate((np.ones(self.first, np.int64), np.frombuffer(raw, "<u4", n, at + 8 * n)))
        self.seq = np.frombuffer(raw, "<u2" if width == 2 else "<u4", m, at + 12 * n).astype(np.int64)
        self.ends = np.cumsum(self.lengths[self.seq])

    def read(self, start: int, n: int) -> np.ndarray:
        """The ids start ... start + n of the block: only the symbols over them are expanded."""
        if n <= 0:
            return np.zeros(0, np.int64)
        lo, hi = np.searchsorted(self.ends, [start, start + n - 1], side="right")
        part = self.seq[lo : hi + 1]
        skip = start - (int(self.ends[lo - 1]) if lo else 0)
        while (deep := part >= self.first).any():
            out = np.repeat(part, np.where(deep, 2, 1))
            at = np.flatnonzero(deep) + np.arange(int(deep.sum()))
            pair = self.rules[part[deep] - self.first]
            out[at], out[at + 1] = pair[:, 0], pair[:, 1]
            part = out
        return part[skip : skip + n]


def cuts_words(tokenizer: str) -> bool:
    """Whether ids of a text are those of its words: a byte-level pattern cut, nothing normalised, put before or after."""
    kind = json.loads(tokenizer)
    pre = kind.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    return bool(plain and not kind.get("normalizer") and kind.get("model", {}).get("type") == "BPE" and not kind["model"].get("ignore_merges"))


#: White space other than a single space or line feed between words, or a NUL: such a text is not cut into words.
WHOLE = "[\\x00\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]|^[ \\n]|[ \\n]$"


class Words:
    """A tokenizer, and the ids of words it met: a worker process keeps one, so that tasks need not start over.

    The ids of word k are pool[start[k] : start[k] + size[k]]; a text's ids are gathered from there."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the threads
        self.coder = Tokenizer.from_str(tokenizer)
        self.added = [t.content for t in self.coder.get_added_tokens_decoder().values()]
        self.cuts = cuts_words(tokenizer)
        vocabulary = self.coder.get_vocab(with_added_tokens=True)
        self.top = max(vocabulary.values())
        self.opens = np.zeros(self.top + 1, bool)  # ids that begin with a space or line feed
        self.opens[[i for t, i in vocabulary.items() if t[:1] in SIGNS]] = True
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.pool, self.size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.coder.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, words: list[str]) -> None:
        """Ids of words (each a space or NUL for a line feed, then no white space), many in one text, cut where they open."""
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            ids = self.ids("".join([x.replace("\x00", "\n") if x[:1] == "\x00" else " " + x for x in part]))
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(part):
                raise ValueError("this vocabulary has words that do not open with a space or line feed")
            self.seen.update(zip(part, range(len(self.seen), len(self.seen) + len(part)), strict=True))
            self.pool.append(ids)
            self.size.append(np.diff(np.append(at, len(ids))))

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of texts, each with the end id after it, one after another; how many each has."""
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        # a text with an added token in it, and any text of a vocabulary of another kind, goes to the library as a whole
        whole = pc.match_substring_regex(texts, WHOLE) if self.cuts else pa.array([True] * len(texts))
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        cut = pc.split_pattern(pc.replace_substring(pc.if_else(whole, "", texts), "\n", " \x00"), " ")
        offsets, values = cut.offsets.to_numpy(), cut.values
        first = np.zeros(len(values), bool)
        first[offsets[:-1]] = True
        coded = values.filter(pa.array(~first)).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.seen) > ROOM:
            self.forget()
        self.learn([w for w in words if w not in self.seen])
        heads = pc.if_else(whole, texts, values.filter(pa.array(first))).to_pylist()
        own = [self.ids(x) if x else np.zeros(0, np.uint32) for x in heads]
        # entries: the words known, these heads, the end
        self.pool, self.size = [np.concatenate(self.pool)], [np.concatenate(self.size)]
        known = len(self.size[0])
        pool = np.concatenate([self.pool[0], *own, np.array([end], np.uint32)])
        size = np.concatenate([self.size[0], np.array([len(x) for x in own], np.int64), [1]])
        start = np.cumsum(size) - size
        entry = np.empty(len(values), np.int64)
        entry[first] = known + np.arange(len(texts))
        entry[~first] = np.fromiter((self.seen[w] for w in words), np.int64, len(words))[coded.indices.to_numpy()] if words else 0
        entry = np.insert(entry, offsets[1:], len(size) - 1)
        long = size[entry]
        at = np.repeat((start[entry] - (np.cumsum(long) - long)).astype(np.int32), long)
        at += np.arange(len(at), dtype=np.int32)
        sizes = np.add.reduceat(long, offsets[:-1] + np.arange(len(texts))) if len(texts) else np.zeros(0, np.int64)
        return pool[at], sizes


@lru_cache(maxsize=1)
def words_of(tokenizer: str) -> Words:
    """This process's words."""
    return Words(tokenizer)


SCHEMA = "shard int, block int, doc_id array<long>, n array<long>, ids binary"
#: Bytes of text that are encoded together.
PIECE = 8_000_000
#: Bytes of text in a shard.
SHARD = 32 << 20


def bounds_of(docs: DataFrame, shards: int) -> list[int]:
    """Ids that cut docs into about equal ranges, by a sketch of the id column alone."""
    if shards < 2:
        return []
    sketch = docs.agg(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)], max(10_000, 20 * shards)).alias("b")).first()
    return sorted(set(sketch["b"] or []))


def written(docs: DataFrame, tokenizer: str, folder: str, shards: int, end: int = END) -> DataFrame:
    """Write docs (doc_id, text) to folder and return the files' rows.

    A row is a block: its documents in order, how many ids each has, and the block's bytes. Documents are encoded where
    they are; what is dealt into shards are ids.
    """
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = np.array(bounds_of(docs, shards), np.int64)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = words_of(shared.value)
        kind = "<u2" if max(coded.top, end) < 65536 else "<u4"
        for batch in batches:
            long = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(long) // PIECE)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                part = batch.slice(lo, hi - lo)
                if not len(part):
                    continue
                ids, sizes = coded(part.column(1), end)
                places = pc.fill_null(part.column(0), np.iinfo(np.int64).min).to_numpy()
                ids, width = ids.astype(kind), np.dtype(kind).itemsize
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64) * width
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, places).astype(np.int32)), part.column(0), part.column(2), pa.array(np.full(len(part), width, np.int32)), raw], ["shard", "doc_id", "h", "width", "ids"])

    ids = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(encoded, "shard int, doc_id long, h long, width int, ids binary")
    ordered = ids.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "doc_id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, names, parts, total = None, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            cells = [shard], [block], [names], [[len(p) for p in parts]], [Block.packed(np.concatenate(parts))]
            kinds = pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], ["shard", "block", "doc_id", "n", "ids"])

        for batch in batches:
            for at, x, width, raw in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if at != shard:
                    if names:
                        yield flush()
                    shard, block, names, parts, total = at, 0, [], [], 0
                names.append(x)
                parts.append(np.frombuffer(raw, "<u2" if width == 2 else "<u4"))
                total += len(parts[-1])
                if total >= BLOCK:
                    yield flush()
                    block, names, parts, total = block + 1, [], [], 0
        if names:
            yield flush()

    ordered.mapInArrow(run, SCHEMA).write.parquet(folder)
    return docs.sparkSession.read.schema(SCHEMA).parquet(folder)


def read_back(files: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit), by random access to its block."""
    # one row a block; blocks are summed up within their shard, shards (one for SHARD bytes) on the driver
    sizes = files.select("shard", "block", F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("size"))
    shards = sizes.groupBy("shard").agg(F.sum("size").alias("size")).orderBy("shard").toArrow()
    starts = shards.set_column(1, "first", pa.array(np.cumsum([0, *shards["size"].to_pylist()], dtype=np.int64)[:-1]))
    within = F.sum("size").over(Window.partitionBy("shard").orderBy("block")) - F.col("size")
    before = sizes.select("shard", "block", within.alias("within")).join(F.broadcast(files.sparkSession.createDataFrame(starts)), "shard")
    before = before.select("shard", "block", (F.col("within") + F.col("first")).alias("before"))
    placed = files.join(small(saved(before, "block-starts")), ["shard", "block"]).select("before", "doc_id", "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, names, sizes, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                block, sizes = Block(raw), np.array(sizes, np.int64)
                starts = np.cumsum(sizes) - sizes
                for k in range(0, len(names), 512):
                    # documents in a row are one stretch of the block
                    part = block.read(int(starts[k]), int(sizes[k : k + 512].sum())).astype("<u4").tobytes()
                    cuts = 4 * (starts[k : k + 513] - starts[k]) if k + 512 < len(names) else 4 * (np.append(starts[k:], sizes.sum()) - starts[k])
                    ids = [part[i:j] for i, j in zip(cuts.tolist(), cuts.tolist()[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(names[k : k + 512], pa.int64()), pa.array(starts[k : k + 512] + before), pa.array(sizes[k : k + 512]), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def shards_for(docs: DataFrame, least: int, size: int = SHARD) -> int:
    """How many shards: one for `size` bytes of text, `least` at least."""
    total = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))).first()[0] or 0
    return max(least, -(-total // size))


def digest(docs: DataFrame, tokenizer: str, shards: int | None = None) -> DataFrame:
    """Per row, from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    shards = shards or shards_for(docs, 2 * spark.sparkContext.defaultParallelism)
    files = written(docs, tokenizer, new_path(spark, "ids"), shards)
    return read_back(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
