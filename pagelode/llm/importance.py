"""Importance resampling towards a target distribution, with exact selection of the winners.

Word runs of every text are hashed into buckets. A bucket's gain is the logarithm of how much more
frequent it is in the target than in the corpus; the gains stand in one array, and a document's weight is the
mean of the array at its features. With Gumbel noise from a hash of the id added, the highest scores are a
sample without replacement.

The last score to be drawn is found by weighted median-of-medians: blocks of rows give the median of the keys
that remain, the medians are weighted by the blocks' remaining sizes, and their weighted median
has at least a quarter of all remaining keys on either side, so every round discards a quarter or
more. Only medians reach the driver, one a block; the winners alone are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.running import running
from pagelode.llm.shared import Scratch, ship
from pagelode.llm.simhash import word_blocks

#: Letters, digits and all bytes of non-ASCII characters stay (A-Z as a-z), the rest separates words.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
KEY = ["k1", "k2", "k3", "k4"]
#: Keys of a block that gives one median.
BLOCK_KEYS = 1 << 20
#: Remaining keys that are sorted directly.
FEW = 10_000


def features(text: bytes | None, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(new words, buckets of all runs of one and two words that end in them) for each stretch of a text."""
    carried = 0
    for words in word_blocks((text or b"").translate(_FOLD), 1):
        ones = list(map(crc32, words))
        twos = map(crc32, [b" " + w for w in words[1:]], ones)
        new = len(words) - carried
        out = np.fromiter(ones[carried:], np.int64, new), np.fromiter(twos, np.int64, max(len(words) - 1, 0))
        yield new, np.concatenate(out) % buckets
        carried = min(len(words), 1)


def bucket_counts(df: DataFrame, text: str, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket; one number a bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                for _, at in features(x.as_py(), buckets):
                    total += np.bincount(at, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in df.select(F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of target to corpus in each bucket, one feature added to each, rounded down."""
    n, all_s, all_t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + n) / ((s + 1) * (all_t + n)))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def scores(df: DataFrame, gain: np.ndarray, seed: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score), one row for each of `df`."""
    ship(df.sparkSession)
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x, h in zip(b.column(1), b.column(2).to_pylist()):
                words = n = total = 0
                for new, at in features(x.as_py(), len(gain)):
                    words, n, total = words + new, n + len(at), total + int(gain[at].sum())
                weight = total // n if n else 0
                rows.append((words, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
            cols = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(cols[:, i]) for i in range(4))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    given = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"), draw.alias("h"))
    return given.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def at_most(key: tuple[int, ...]) -> Column:
    return F.struct(*KEY) <= F.struct(*(F.lit(int(k)).cast("long").alias(c) for k, c in zip(key, KEY)))


def medians(keys: DataFrame, pivot: tuple[int, ...] | None) -> dict[bool, list[tuple[int, tuple[int, ...]]]]:
    """For the keys up to the pivot (True) and beyond it (False): size and median of each block."""

    def summary(block: np.ndarray) -> Iterator[tuple]:
        block = block[np.lexsort(block.T[::-1])]
        low = np.zeros(len(block), bool) if pivot is None else _not_after(block, pivot)
        for side in (True, False):
            part = block[low == side]
            if len(part):
                yield (side, len(part), *map(int, part[(len(part) - 1) // 2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, out = [], 0, []
        for b in batches:
            held.append(np.column_stack([c.to_numpy() for c in b.columns]))
            n += b.num_rows
            if n >= BLOCK_KEYS:
                out += summary(np.concatenate(held))
                held, n = [], 0
        if n:
            out += summary(np.concatenate(held))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["low", "n", *KEY])

    rows = keys.select(*KEY).mapInArrow(run, "low boolean, n long, " + ", ".join(f"{k} long" for k in KEY)).collect()
    return {side: [(r["n"], tuple(r[k] for k in KEY)) for r in rows if r["low"] == side] for side in (True, False)}


def _not_after(block: np.ndarray, pivot: tuple[int, ...]) -> np.ndarray:
    """Which keys are at most the pivot, by the first column that differs."""
    out = np.ones(len(block), bool)
    for i in range(len(pivot) - 1, -1, -1):
        out = (block[:, i] < pivot[i]) | ((block[:, i] == pivot[i]) & out)
    return out


def weighted_median(blocks: list[tuple[int, tuple[int, ...]]]) -> tuple[int, ...]:
    """The smallest median up to which blocks hold half of all keys."""
    half, seen = sum(n for n, _ in blocks) / 2, 0
    for n, key in sorted(blocks, key=lambda x: x[1]):
        seen += n
        if seen >= half:
            return key
    raise ValueError("no blocks")


def nth_key(keys: DataFrame, take: int, scratch: Scratch) -> tuple[int, ...]:
    """The `take`-th smallest key (from 1) of a table of unique keys."""
    side = medians(keys, None)[False]
    left = stored = sum(n for n, _ in side)
    while left > FEW:
        pivot = weighted_median(side)
        sides = medians(keys, pivot)
        low = sum(n for n, _ in sides[True])
        goes_low = take <= low
        keys = keys.filter(at_most(pivot) if goes_low else ~at_most(pivot))
        take, left, side = (take, low, sides[True]) if goes_low else (take - low, left - low, sides[False])
        if left * 4 <= stored:  # what is left is written, so later rounds read no more than that
            keys, stored = scratch.cut(keys), left
    return sorted(tuple(r) for r in keys.select(*KEY).collect())[take - 1]


def resample(df: DataFrame, target: DataFrame, scratch: Scratch, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7, text: str = "text", doc_id: str = "doc_id", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of `df`, all long.

    Of the N rows with at least `least_words` words, floor(percent * N / 100) are drawn by score; rank
    counts them from 1, and is null for the rest. Ties go to the smaller doc_id. Null texts have no
    words, no features and weight 0. A null doc_id draws as the empty id and loses ties. Rows that
    repeat a doc_id are drawn each for itself; if their scores tie, the one with fewer features comes first. Columns that are not named are
    not read. An empty table gives no rows; an empty target is no error.
    """
    ship(df.sparkSession)
    gain = gains(bucket_counts(df, text, buckets), bucket_counts(target, target_text, buckets))
    key = [-F.col("score"), F.coalesce("doc_id", F.lit((1 << 63) - 1)), F.col("n_features"), F.monotonically_increasing_id()]
    scored = scratch.cut(scores(df, gain, seed, text, doc_id).select("*", *(k.alias(c) for k, c in zip(key, KEY))))
    fit = F.col("n_words") >= least_words
    take = percent * scored.filter(fit).count() // 100
    drawn = fit & at_most(nth_key(scored.filter(fit), take, scratch)) if take else F.lit(False)
    winners, _ = running(scored.filter(drawn).withColumn("one", F.lit(1)), scratch, [F.col(k) for k in KEY], "one")
    columns = ["doc_id", "n_features", "weight", "score"]
    return winners.select(*columns, (F.col("before") + 1).alias("rank")).unionByName(scored.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
