"""Word n-grams that the texts of a table share with those of the next key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3, 4)
#: Keys of a bucket as a power of two; the first text of a bucket also goes to the one before it.
SPAN = 6
#: Rows whose n-grams are counted together.
ROWS = 512


def matches(words: pa.ListArray, group: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """For each order and group, how many n-grams it shares with the next group, each as often as the lesser count has it
    (0 where not linked). group: of each list, ascending. An n-gram is met only if both its shorter ones are."""
    offsets = words.offsets.to_numpy()
    w = words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    long = np.diff(offsets)
    ends, of = np.repeat(offsets[1:] - offsets[0], long), np.repeat(group, long)
    many = int(w.max(initial=0)) + 1
    out = np.zeros((len(ORDERS), len(linked)), np.int64)
    at, code, met = np.arange(len(w)), w, np.ones(len(w) + 1, bool)
    for n in ORDERS:
        if n > 1:
            keep = met[at] & met[at + 1] & (at + n <= ends[at])
            at = at[keep]
            code = np.unique(code[keep] * many + w[at + n - 1], return_inverse=True)[1]
        wide = int(code.max(initial=0)) + 1
        keys, place, count = np.unique(of[at] * wide + code, return_inverse=True, return_counts=True)
        other = np.minimum(np.searchsorted(keys, keys + wide), max(len(keys) - 1, 0))
        hit = np.flatnonzero(linked[keys // wide] & (keys[other] == keys + wide))
        np.add.at(out[n - 1], keys[hit] // wide, np.minimum(count[hit], count[other[hit]]))
        both = np.zeros(len(keys), bool)
        both[hit] = both[other[hit]] = True
        met = np.zeros(len(w) + 1, bool)
        met[at] = both[place]
    return out


def next_matches(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Per key that has a next one (key + 1): key, h and r (their texts' words), m1 to m4, the n-grams of each order that they share.

    Words are what single spaces part; null counts as empty. Texts meet where they are dealt, so no n-gram is shuffled.
    Rows of one key are held together and counted as one; they give a row for each distinct (h, r). Null keys have no next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def counted(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
            bucket, k = rows["bucket"].to_numpy(), rows["k"].to_numpy()
            new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (k[1:] != k[:-1])))
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
            linked = np.zeros(len(first), bool)
            linked[:-1] = (bucket[first[1:]] == bucket[first[:-1]]) & (k[first[1:]] == k[first[:-1]] + 1)
            rest = None
            if not last:  # the last key may go on, so the pair before it waits as well
                linked[-2:] = False
                rest = rows.slice(int(first[max(len(first) - 2, 0)]))
            words = pc.split_pattern(pc.fill_null(rows["t"], "").combine_chunks(), " ")
            m, size = matches(words, group, linked), np.diff(words.offsets.to_numpy())
            bounds, found = np.append(first, len(k)), []
            for g in np.flatnonzero(linked).tolist():
                own, other = (np.unique(size[bounds[i] : bounds[i + 1]]).tolist() for i in (g, g + 1))
                found += [(k[first[g]], h, r, *m[:, g]) for h in own for r in other]
            columns = np.array(found, np.int64).reshape(-1, 3 + len(ORDERS)).T
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [key, "h", "r", *[f"m{n}" for n in ORDERS]]), rest

        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = pa.Table.from_batches([batch.slice(i, ROWS)])
                out, held = counted(pa.concat_tables([held, part]) if held is not None else part, False)
                yield out
        if held is not None:
            yield counted(held, True)[0]

    k, own = F.col("k"), F.shiftright("k", SPAN)
    buckets = F.when(k.bitwiseAND(F.lit((1 << SPAN) - 1)) == 0, F.array(own, own - 1)).otherwise(F.array(own))
    rows = texts.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("k IS NOT NULL").select(F.explode(buckets).alias("bucket"), "k", "t")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "k").mapInArrow(run, ", ".join(f"{c} long" for c in (key, "h", "r", *[f"m{n}" for n in ORDERS])))
