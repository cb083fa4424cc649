"""Best-fit packing of tokenised documents into sequences of fixed length.

Best-fit decreasing looks only at lengths, and there are at most `max_len` of them. So the driver
packs the histogram of lengths, not the documents: items of one length are placed in whole runs of
bins with equal remaining capacity, and a segment tree over the capacities finds the tightest open
bin in logarithmic time. The outcome is the one that best-fit decreasing gives item by item, and
its size depends on `max_len` alone. Executors then number the pieces of each length and look
their place up in the plan.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelode.llm.bpe import vocabulary
from pagelode.llm.shared import Scratch, ship

#: Rows that share a length are numbered within salts of about this many rows.
SALT_ROWS = 200_000


class Capacities:
    """Segment tree over capacities 0..size: how many bins are open at each, tightest fit in O(log size)."""

    def __init__(self, size: int):
        self.width = 1
        while self.width <= size:
            self.width *= 2
        self.open = [0] * (2 * self.width)

    def add(self, capacity: int, bins: int) -> None:
        at = capacity + self.width
        while at:
            self.open[at] += bins
            at //= 2

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least `need` that an open bin has."""
        at = need + self.width
        if self.open[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:  # the right neighbour covers larger capacities
                at += 1
                while at < self.width:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def best_fit(histogram: dict[int, int], max_len: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over {length: count}.

    Returns placements (length, first, count, sequence, each, offset): the items number first,
    first + 1, ... of that length go `each` to a sequence, from `sequence` on, beginning at `offset`.
    """
    tree, bins, plan, opened = Capacities(max_len), defaultdict(list), [], 0
    for length in sorted(histogram, reverse=True):
        left, first = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, start, n = max_len, opened, -(-left // (max_len // length))
                opened += n
            else:
                start, n = bins[capacity].pop()
                tree.add(capacity, -n)
            each = capacity // length
            full, rest = min(n, left // each), 0
            if full < n and left - full * each:
                rest = left - full * each
            for at, k, t in ((start, full, each), (start + full, 1, rest)):
                if k and t:
                    plan.append((length, first, k * t, at, t, max_len - capacity))
                    first, left = first + k * t, left - k * t
                    bins[capacity - t * length].append((at, k))
                    tree.add(capacity - t * length, k)
            used = full + bool(rest)
            if used < n:
                bins[capacity].append((start + used, n - used))
                tree.add(capacity, n - used)
    return plan


def cut_lengths(total: int, max_len: int) -> list[int]:
    """Lengths of a document's pieces: the remainder first, then full ones."""
    first = total % max_len
    return ([first] if first else []) + [max_len] * (total // max_len)


def added_tokens(path: str) -> dict[str, int]:
    """Added tokens of a tokenizer's JSON file, which the `tokenizers` library recognises inside texts."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    odd = [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if odd:
        raise ValueError(f"added tokens that take in their surroundings are not supported: {odd}")
    return {t["content"]: t["id"] for t in added}


_ENCODERS: dict[tuple, tiktoken.Encoding] = {}


def encoder(path: str, pattern: str, ranks, added: dict[str, int]) -> tiktoken.Encoding:
    """This worker's encoder for a broadcast vocabulary."""
    key = (path, pattern, *sorted(added.items()))
    if key not in _ENCODERS:
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens=added)
    return _ENCODERS[key]


def pieces(df: DataFrame, path: str, pattern: str, end_id: int, max_len: int, text: str = "text", doc_id: str = "doc_id", with_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """Tokenise whole texts, append `end_id`, cut what is longer than `max_len`.

    `added` are tokens beside the rank file that count as one wherever a text holds them; without it
    such text is tokenised like any other.

    Returns doc_id, piece, start, length, ids_crc32 and, on request, the piece's ids as
    little-endian unsigned 32-bit integers. `path` is a rank file of the vocabulary. A null text
    counts as empty and gives one piece that holds `end_id` alone; repeated rows give repeated
    pieces; other columns are not carried.
    """
    ship(df.sparkSession)
    v = vocabulary(path, pattern)
    ranks = df.sparkSession.sparkContext.broadcast(dict(zip(v.tokens, v.ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern, ranks, added or {}).encode_to_numpy
        end = np.array([end_id], "<u4")
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encode(x.as_py() or "", allowed_special="all", disallowed_special=()).astype("<u4", copy=False), end])
                at = 0
                for k, n in enumerate(cut_lengths(len(ids), max_len)):
                    raw = ids[at : at + n].tobytes()
                    for c, value in zip(out, (doc, k, at, n, zlib.crc32(raw), raw if with_ids else None)):
                        out[c].append(value)
                    at += n
            types = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
            yield pa.RecordBatch.from_pydict({c: pa.array(x, types[c]) for c, x in out.items() if c != "ids" or with_ids})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def numbered(items: DataFrame, total: int) -> DataFrame:
    """Add `number`, 0, 1, 2, ... within each length, without gathering a length in one task.

    Rows are numbered within (length, salt); the salts' counts, added up per length, say where
    each salt begins.
    """
    salts = max(32, -(-total // SALT_ROWS))
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("begins"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    return salted.withColumn("own", own).join(starts, ["length", "salt"]).withColumn("number", F.col("begins") + F.col("own") - 1).drop("salt", "own", "begins")


def pack(items: DataFrame, max_len: int, scratch: Scratch) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    `items` is written to the shared folder once. An empty table gives an empty result. Pieces of
    equal length are interchangeable; ties go by doc_id, piece and checksum, so the outcome does
    not depend on task order.
    """
    items = scratch.cut(items)
    histogram = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}  # at most max_len rows
    plan = sorted(best_fit(histogram, max_len))
    spark = items.sparkSession
    table = spark.sparkContext.broadcast(np.array(plan, np.int64).reshape(-1, 6))
    spread = numbered(items, sum(histogram.values()))
    names = [c for c in spread.columns if c != "number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, sequence, each, offset = table.value.T
        keys = (length << 44) + first
        for batch in batches:
            own = pa.Table.from_batches([batch])
            n, k = own["length"].to_numpy(), own["number"].to_numpy()
            at = np.searchsorted(keys, (n << 44) + k, "right") - 1
            d = k - first[at]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in names]
            arrays += [pa.array(sequence[at] + d // each[at]), pa.array(offset[at] + d % each[at] * n)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.select(names).schema)
    return spread.mapInArrow(run, schema + ", sequence_id long, offset long")
