"""Byte-level BPE: ranked merges folded over byte arrays of distinct words.

The most frequent words (a bounded number) are folded once by Spark higher-order functions: the word's byte ids, then
again and again the leftmost pair of the lowest rank joined, with the rank map as a literal (two gets into a
row-displaced table). Their ids form a bounded dictionary. The documents look words up in it; distinct words beyond it
are folded in the task that meets them, by the same merges and the same rank map, many words at a time. Documents are
never shuffled. Decoding concatenates the ids' binary pieces.

A task works on some MB of texts at once: pieces and words are told apart as Arrow dictionaries, so each distinct piece
is cut into words once, each distinct word is folded once, and ids and bytes of texts are gathered by place.

Null text counts as empty and has no ids. Repeated rows each get a row. Other columns of the input are kept.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from platewise.llm.common import constant, count_floor, let, saved

NONE = 2_147_483_647
#: Words in the dictionary: some 8 MB with their ids.
DICTIONARY = 1 << 16
#: Bytes of a word from which it is folded with a heap instead of in a matrix.
LONG = 128
#: Texts that cannot be cut before single spaces and line feeds: other white space, runs of it or some at an end; empty
#: texts; NUL and SOH, which mark pieces.
ODD = r"\A\z|\A[ \n]|[ \n]\z|[ \n][ \n]|[\x00\x01\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def parts(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and data of an array of strings or bytes."""
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    _, at, data = values.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """data cut at offsets (in bytes)."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def ends(counts: np.ndarray) -> np.ndarray:
    """0 and the running totals of counts."""
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


class Ranks:
    """The merges of a tiktoken rank file: id of byte i, id of a joined pair, bytes of an id."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern, self.size = pattern, max(ranks.values()) + 1
        pairs: dict[int, list[tuple[int, int]]] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.setdefault(a, []).append((b, rank))
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pieces = [b""] * self.size
        for token, rank in ranks.items():
            pieces[rank] = token
        self.pieces = pa.array(pieces, pa.large_binary())
        # rows of (b, rank) laid over one array, each shifted by base[a] to where its places are free
        self.owner, self.value, self.base = np.full(16 * self.size, -1, np.int32), np.zeros(16 * self.size, np.int32), np.full(self.size, -self.size, np.int32)
        rng, free = np.random.default_rng(0), 0
        for a, row in sorted(pairs.items(), key=lambda x: (-len(x[1]), x[0])):
            at = np.array([b for b, _ in row])
            if len(row) == 1:  # any free place will do
                while free < at[0] or self.owner[free] >= 0:
                    free += 1
                shift = free - int(at[0])
            else:
                while (self.owner[(shift := int(rng.integers(0, len(self.owner) - int(at.max())))) + at] >= 0).any():
                    pass
            self.base[a], self.owner[shift + at], self.value[shift + at] = shift, a, [r for _, r in row]

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        place = self.base[a] + b
        inside = (place >= 0) & (place < len(self.owner))
        place = np.where(inside, place, 0)
        return np.where(inside & (self.owner[place] == a), self.value[place], NONE)

    def joined(self, ids: pa.Array) -> pa.Array:
        """The bytes that each row's ids (little-endian unsigned 32-bit integers) stand for."""
        offsets, data = parts(pc.fill_null(ids, b""))
        at, out = parts(self.pieces.take(pa.array(data[offsets[0] : offsets[-1]].view("<u4"))))
        return binaries(out, at[(offsets - offsets[0]) // 4])

    def fold_many(self, words: pa.Array) -> pa.Array:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        offsets, data = parts(words)
        sizes = np.diff(offsets)
        order, counts, ids, first = np.argsort(sizes, kind="stable"), np.zeros(len(words), np.int64), [np.zeros(0, "<u4")], 0
        for n, m in zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True):
            group, first = order[first : first + m], first + m
            step = max(1, 1_000_000 // max(1, n * n)) if n <= LONG else 1
            for k in range(0, m, step):
                part = group[k : k + step]
                raw = self.bytes[data[offsets[part][:, None] + np.arange(n)]]
                flat, counts[part] = self._fold_matrix(raw) if n <= LONG else self._fold_long(raw[0])
                ids.append(flat)
        back = np.empty(len(words), np.int64)
        back[order] = np.arange(len(words))
        return binaries(np.concatenate(ids).astype("<u4"), 4 * ends(counts[order])).take(pa.array(back))

    def _fold_matrix(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of one length, one after another, and each word's number of ids."""
        out, counts, rows = ids.copy(), np.zeros(len(ids), np.int64), np.arange(len(ids))
        ranks = self.merged(ids[:, :-1], ids[:, 1:])
        while len(ids) and (width := ids.shape[1]) > 1:
            each, at = np.arange(len(ids)), ranks.argmin(axis=1)
            best = ranks[each, at]
            if (over := best == NONE).any():
                out[rows[over], :width], counts[rows[over]] = ids[over], width
                rows, ids, ranks, at, best = (x[~over] for x in (rows, ids, ranks, at, best))
                each = each[: len(rows)]
            ids[each, at] = best
            kept = np.ones(ids.shape, bool)
            kept[each, at + 1] = False
            ids = ids[kept].reshape(len(rows), width - 1)
            kept = np.ones(ranks.shape, bool)
            kept[each, at] = False
            ranks = ranks[kept].reshape(len(rows), width - 2)
            for side, has in ((at - 1, at > 0), (at, at < width - 2)):
                r, c = each[has], side[has]
                ranks[r, c] = self.merged(ids[r, c], ids[r, c + 1])
        out[rows, : ids.shape[1]], counts[rows] = ids, ids.shape[1]
        return out[np.arange(out.shape[1]) < counts[:, None]], counts

    def _fold_long(self, ids: np.ndarray) -> tuple[np.ndarray, int]:
        ids = ids.tolist()
        base, owner, value, top = self.base, self.owner, self.value, len(self.owner)

        def rank(a: int, b: int) -> int | None:
            place = int(base[a]) + b
            return int(value[place]) if 0 <= place < top and owner[place] == a else None

        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank(ids[x], ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        out = np.array([x for x in ids if x >= 0], np.int32)
        return out, len(out)


class Fold:
    """The same fold as a Spark column: word -> array of ids."""

    def __init__(self, spark: SparkSession, ranks: Ranks):
        row = pa.table({n: pa.array([x], pa.list_(pa.int32())) for n, x in (("base", ranks.base), ("owner", ranks.owner), ("value", ranks.value), ("bytes", ranks.bytes))})
        self.base, self.owner, self.value, self.bytes = constant(spark.createDataFrame(row))

    def merge(self, a: Column, b: Column) -> Column:
        place = F.get(self.base, a) + b
        return F.when(F.get(self.owner, place) == a, F.get(self.value, place)).otherwise(F.lit(NONE))

    def __call__(self, word: Column) -> Column:
        none = F.array().cast("array<int>")
        ids = F.transform(F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), ""), lambda c: F.get(self.bytes, F.ascii(c)))

        def state(p: Column, r: Column) -> Column:
            return F.struct(p.alias("p"), r.alias("r"), F.coalesce(F.array_min(r), F.lit(NONE)).alias("m"))

        def start(p: Column) -> Column:
            ranks = F.when(F.size(p) < 2, none).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(p) - 2, F.lit(0))), lambda i: self.merge(F.get(p, i), F.get(p, i + 1))))
            return let(ranks, lambda r: state(p, r))

        def joined(s: Column) -> Column:
            p, r, m, n = s["p"], s["r"], s["m"], F.size(s["p"])

            def around(j: Column) -> Column:  # j: place of the pair, from 1
                pieces = F.concat(F.slice(p, 1, j - 1), F.array(m), F.slice(p, j + 2, n))
                before = F.when(j > 1, F.concat(F.slice(r, 1, F.greatest(j - 2, F.lit(0))), F.array(self.merge(F.get(p, j - 2), m)))).otherwise(none)
                after = F.when(j + 1 < n, F.concat(F.array(self.merge(m, F.get(p, j + 1))), F.slice(r, j + 2, n))).otherwise(none)
                return let(F.concat(before, after), lambda x: state(pieces, x))

            return let(F.array_position(r, m).cast("int"), around)

        folded = let(ids, lambda p: F.aggregate(p, start(p), lambda s, _: F.when(s["m"] == NONE, s).otherwise(joined(s)), lambda s: s["p"]))
        return F.when(F.octet_length(word) > 0, folded).otherwise(none)


def dictionary(docs: DataFrame, ranks: Ranks, text: str = "text", most: int = DICTIONARY) -> tuple[pa.Array, pa.Array]:
    """At most `most` of the most frequent words, and their ids as little-endian 32-bit integers.

    A task reports only words that are at least 1 in 4 * most of its own, so what it holds and sends is bounded;
    which words are in the dictionary has no effect on the ids. Words of odd texts are not counted.
    """
    pattern = ranks.pattern

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, words, n, total = regex.compile(pattern).findall, pa.array([], pa.string()), np.zeros(0, np.int64), 0
        for batch in batches:
            for texts in portions(batch.column(0)):
                new = Cut(find, texts.filter(pc.invert(odd(texts))))
                uses = np.bincount(new.units, minlength=len(new.first) - 1)
                n = np.concatenate([n, np.bincount(new.at, np.repeat(uses, np.diff(new.first)), len(new.words)).astype(np.int64)])
                total += int(n[len(words) :].sum())
                both = pa.concat_arrays([words, new.words]).dictionary_encode()
                words, n = both.dictionary, np.bincount(both.indices.to_numpy(), n, len(both.dictionary)).astype(np.int64)
                if len(words) > 4 * most:  # lossy counting: what is below the share so far goes
                    words, n = words.filter(pa.array(keep := n > total // (4 * most))), n[keep]
                pa.default_memory_pool().release_unused()
        keep = n >= max(2, total // (4 * most))
        yield pa.RecordBatch.from_arrays([words.filter(pa.array(keep)), pa.array(n[keep])], ["word", "n"])

    counts = saved(docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    floor = count_floor(counts, "n", most, 2)
    fold = Fold(docs.sparkSession, ranks)
    # each task reads the rank map of 7 MB anew, so tasks are few
    frequent = counts.where(F.col("n") >= floor).repartition(24).select("word", fold(F.col("word")).alias("ids"))
    found = frequent.toArrow().combine_chunks()  # `most` rows at most
    words, ids = (pa.concat_arrays([pa.array([], kind), *found[name].chunks]) for name, kind in (("word", pa.string()), ("ids", found.schema.field("ids").type)))
    return words, binaries(ids.flatten().to_numpy().astype("<u4"), 4 * ends(pc.list_value_length(ids).to_numpy()))


def odd(texts: pa.Array) -> pa.Array:
    """Whether words must be found in each text as a whole."""
    return pc.match_substring_regex(pc.fill_null(texts, ""), ODD)


class Cut:
    """Texts as units: distinct pieces, which no word can span, and whole odd texts.

    `units` has the units of each text one after another, those of text k from bounds[k] to bounds[k + 1]; `at` has
    the words of each unit, as places in the distinct `words`, those of unit k from first[k] to first[k + 1].
    """

    def __init__(self, find: Callable[[str], list[str]], texts: pa.Array):
        texts, whole = pc.fill_null(texts, ""), odd(texts)
        # a piece starts with SOH at a text's start, with NUL after a line feed, else after a space
        split = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\x01"), texts.filter(pc.invert(whole)), ""), "\n", " \x00"), " ")
        coded = split.flatten().dictionary_encode()
        pieces, whole = coded.dictionary, whole.to_numpy(zero_copy_only=False)
        line = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), " ")[0].as_py()
        found = [pa.array(find((" " + line).replace(" \x01", "\n").replace(" \x00", "\n")) if len(pieces) else [], pa.string())]
        # a space or line feed stands first in each piece and nowhere else; the one put before a text's start goes
        offsets, data = parts(found[0])
        head = data[offsets[:-1]]
        begin = np.flatnonzero((head == 32) | (head == 10))
        assert len(begin) == len(pieces)
        added = begin[pc.starts_with(pieces, "\x01").to_numpy(zero_copy_only=False)]
        count = np.diff(begin, append=len(head))
        count[np.searchsorted(begin, added)] -= 1
        found[0] = found[0].filter(pa.array(np.isin(np.arange(len(head)), added, invert=True)))
        found += (pa.array(find(x.as_py()), pa.string()) for x in texts.filter(pa.array(whole)))
        words = pa.concat_arrays(found).dictionary_encode()
        self.words, self.at = words.dictionary, words.indices.to_numpy()
        self.first = ends(np.concatenate([count, [len(x) for x in found[1:]]]))
        n = np.ones(len(texts), np.int64)
        n[~whole] = pc.list_value_length(split).to_numpy()
        self.bounds = ends(n)
        self.units = np.empty(self.bounds[-1], np.int64)
        plain = np.ones(len(self.units), bool)
        plain[lone := self.bounds[:-1][whole]] = False
        self.units[lone], self.units[plain] = len(pieces) + np.arange(len(lone)), coded.indices.to_numpy()


class Encoder:
    """Texts to ids, in one task: `known` words by look-up, others folded once and kept while there is room."""

    ROOM = 150_000

    def __init__(self, ranks: Ranks, known: tuple[pa.Array, pa.Array]):
        import regex

        self.find, self.ranks, self.known = regex.compile(ranks.pattern).findall, ranks, known
        self.words, self.ids = known

    def __call__(self, texts: pa.Array) -> pa.Array:
        """The ids of some MB of texts, or of one longer text."""
        cut = Cut(self.find, texts)
        if len(self.words) > self.ROOM + len(self.known[0]):
            self.words, self.ids = self.known
        place = pc.fill_null(pc.index_in(cut.words, self.words), -1).to_numpy().copy()
        lacking = cut.words.filter(pa.array(new := place < 0))
        if len(lacking):
            place[new] = len(self.words) + np.arange(len(lacking))
            self.words, self.ids = pa.concat_arrays([self.words, lacking]), pa.concat_arrays([self.ids, self.ranks.fold_many(lacking)])
        at, data = parts(self.ids.take(pa.array(place[cut.at])))
        at, data = parts(binaries(data, at[cut.first]).take(pa.array(cut.units)))
        return binaries(data, at[cut.bounds])


def portions(texts: pa.Array, size: int = 2_000_000) -> Iterator[pa.Array]:
    """texts in slices of about `size` bytes; a longer text stands alone."""
    end, k = ends(pc.fill_null(pc.binary_length(texts), 0).to_numpy()), 0
    while k < len(texts):
        stop = max(k + 1, int(np.searchsorted(end, end[k] + size, "right")) - 1)
        yield texts.slice(k, stop - k)
        k = stop


def encode(docs: DataFrame, ranks: Ranks, text: str = "text", out: str = "ids", most: int = DICTIONARY) -> DataFrame:
    """docs with the ids (binary: little-endian unsigned 32-bit integers) of each text."""
    return _encoded(docs, ranks, text, most, docs.columns, [StructField(out, BinaryType())], lambda _, ids: [ids.cast(pa.binary())])


def _encoded(docs: DataFrame, ranks: Ranks, text: str, most: int, kept: list[str], new: list[StructField], made: Callable[[Ranks, pa.Array], list[pa.Array]]) -> DataFrame:
    """The first columns of docs, `kept`, with those that `made` gives for the ranks and the ids of some texts."""
    shared = docs.sparkSession.sparkContext.broadcast((vars(ranks), dictionary(docs, ranks, text, most)))
    place, width = docs.columns.index(text), len(kept)
    names, fields = [*kept, *(f.name for f in new)], StructType([*docs.schema.fields[:width], *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, known = shared.value
        ranks = Ranks.__new__(Ranks)
        vars(ranks).update(state)
        encoder = Encoder(ranks, known)
        for batch in batches:
            k = 0
            for texts in portions(batch.column(place)):
                part = batch.slice(k, len(texts))
                k += len(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *made(ranks, encoder(texts))], names)
                pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, fields)


def decode(docs: DataFrame, ranks: Ranks, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """docs with the bytes that ids (binary, as of encode) stand for."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks.pieces)
    place, fields = docs.columns.index(ids), StructType([*docs.schema.fields, StructField(out, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks.__new__(Ranks)
        ranks.pieces = shared.value
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, ranks.joined(part.column(place)).cast(pa.binary())], [*part.schema.names, out])

    return docs.mapInArrow(run, fields)


def digest(docs: DataFrame, ranks: Ranks, most: int = DICTIONARY) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256. Ids are decoded and hashed in the task that made them."""

    def sha(values: pa.Array) -> pa.Array:
        at, data = parts(values)
        return pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in itertools.pairwise(at.tolist())], pa.string())

    def hashed(ranks: Ranks, ids: pa.Array) -> list[pa.Array]:
        return [pa.array(np.diff(parts(ids)[0]) // 4), sha(ids), sha(ranks.joined(ids))]

    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return _encoded(docs.select("doc_id", "text"), ranks, "text", most, ["doc_id"], fields, hashed)
