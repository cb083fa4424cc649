"""Removal of repeated passages by sorting suffixes: a distributed merge sort that knows common prefixes.

A byte goes if a run of `length` bytes that covers it also starts anywhere else. Sorting all
suffixes of a corpus would move every byte many times, so only suffixes at anchors are sorted. The
anchor of a window of `length` bytes is the place of its smallest k-gram hash, leftmost among
equals; it depends on the window's bytes alone, so equal windows have equal anchors, and an anchor
whose k-gram is the only one of its kind cannot lie in a repeated window. What is left is sorted:

1. tasks sort the suffixes at repeated anchors and front-code them into runs (length of the prefix
   shared with the suffix before, remaining bytes, and the bytes left of the anchor);
2. runs are exchanged by k-gram and merged with loser trees that compare suffixes from their known
   common prefix on and never before it;
3. in the merged order, two anchors agree on the shortest common prefix between them (right), and
   on a common suffix of what precedes them (left); together these say which windows repeat.

Identical texts are combined before all that: a text that occurs twice is wholly repeated. A
k-gram that is more frequent than `HOT` would fill one task; its windows are counted by digest
instead, combined before the shuffle, which is exact as well.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.shared import Scratch, partitions_for

#: Bytes whose anchors are found at once; positions must fit the low 20 bits of a packed minimum.
BLOCK = 1 << 20
_POSITION = np.uint64(BLOCK - 1)
#: Suffixes of one sorted run, at most.
RUN = 20_000
#: Suffixes that one merge takes, on average.
MERGE = 60_000
#: Anchors of one k-gram beyond which its windows are counted by digest.
HOT = 100_000
#: Bytes of distinct texts in one bucket of the shared table.
BUCKET_BYTES = 96 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for name, x in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(BLOCK, x, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k-gram of at most BLOCK bytes, from differences of one running sum."""
    up, down = powers()
    n = len(data) - k + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[k:] - sums[:n]) * down[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, from running minima within blocks of w."""
    n = len(v) - w + 1
    blocks = -(-len(v) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows: text number, position, least and greatest offset of the anchor in its windows, hash."""
    found: list[list[np.ndarray]] = [[] for _ in range(5)]
    batch: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        if not batch:
            return
        data = np.frombuffer(b"".join(x for _, _, x in batch), np.uint8)
        sizes = np.array([len(x) for _, _, x in batch])
        h = gram_hashes(data, k)
        low = sliding_min((h & ~_POSITION) | np.arange(len(h), dtype=np.uint64), length - k + 1)
        ends = np.cumsum(sizes)
        windows = np.concatenate([np.arange(e - s, e - length + 1) for s, e in zip(sizes, ends)])
        at = (low[windows] & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        a = at[first]
        which = np.searchsorted(ends, a, "right")
        number = np.array([x for x, _, _ in batch])[which]
        shift = np.array([y for _, y, _ in batch])[which] - (ends - sizes)[which]
        for out, x in zip(found, (number, a + shift, a - windows[last], a - windows[first], h[a])):
            out.append(x)
        batch.clear()

    held, step = 0, BLOCK - length
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), step):  # parts of long texts overlap so that each window is in one
            part = t[at : at + step + length - 1] if len(t) >= BLOCK else t
            if held + len(part) > BLOCK - 1:
                flush()
                held = 0
            batch.append((i, at, part))
            held += len(part)
            if len(t) < BLOCK:
                break
    flush()
    if not found[0]:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    number, position, least, most, h = (np.concatenate(x) for x in found)
    again = np.concatenate([[False], (number[1:] == number[:-1]) & (position[1:] == position[:-1])])  # an anchor on both sides of a cut
    starts = np.flatnonzero(~again)
    stops = np.append(starts[1:], len(number)) - 1
    return number[starts], position[starts], np.minimum(least[starts], least[stops]), np.maximum(most[starts], most[stops]), h[starts]


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that agree on their first `known` bytes."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(entries: list[tuple]) -> bytes:
    """Sorted (right, left, rest...) as a run: shared prefix with the entry before, remaining bytes, left, rest."""
    out, before = [], b""
    for right, left, *rest in entries:
        n = common(before, right)
        out.append((n, right[n:], left, *rest))
        before = right
    return pickle.dumps(out, 5)


def read_run(block: bytes) -> Iterator[tuple]:
    """(prefix shared with the entry before, right, left, rest...) of a front-coded run."""
    before = b""
    for n, tail, left, *rest in pickle.loads(block):
        before = before[:n] + tail
        yield (n, before, left, *rest)


def merge(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merge front-coded runs with a loser tree; yields (prefix shared with the output before, right, left, rest...).

    `shared[i]` is what the head of run i has in common with the last output. Of two heads the one
    that shares more comes first, unseen; only heads that share the same are compared, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[tuple | None] = [next(r, None) for r in runs] + [None] * (size - len(runs))
    shared = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared length becomes that with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        r, s = x[1], y[1]
        n = common(r, s, shared[a])
        if n == len(r) == len(s):
            first = x[2] <= y[2]
        else:
            first = n == len(r) or (n < len(s) and r[n] < s[n])
        if first:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    losers = [0] * size
    winners = list(range(size)) if size == 1 else [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if size > 1 else 0
    while (head := heads[top]) is not None:
        yield (shared[top], *head[1:])
        heads[top] = new = next(runs[top], None)
        shared[top] = new[0] if new else 0
        node = (top + size) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def repeated_offsets(group: list[tuple[int, bytes, bytes]], length: int) -> list[list[tuple[int, int]]]:
    """For anchors in merged order (prefix shared with the one before, right, left): offsets at which their windows repeat.

    A window reaching o bytes left of its anchor repeats if another anchor agrees on o bytes to the
    left and length - o to the right. Neighbours are joined from the longest common prefix down;
    every cluster keeps its anchors in the order of what lies left of them, where the best partner
    is next to each, and the smaller cluster is put into the larger one.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in group]
    own = list(range(len(group)))
    clusters = [[(g[2], i)] for i, g in enumerate(group)]

    def find(i: int) -> int:
        while own[i] != i:
            own[i] = own[own[i]]
            i = own[i]
        return i

    for i in sorted(range(1, len(group)), key=lambda i: -group[i][0]):
        right = group[i][0]
        a, b = find(i - 1), find(i)
        if len(clusters[a]) < len(clusters[b]):
            a, b = b, a
        large = clusters[a]
        for item in clusters[b]:
            at = bisect_left(large, item)
            for j in (at - 1, at):
                if 0 <= j < len(large):
                    left = common(item[0], large[j][0])
                    if length - right <= left:
                        out[item[1]].append((length - right, left))
                        out[large[j][1]].append((length - right, left))
            large.insert(at, item)
        clusters[b] = []
        own[b] = a
    return out


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of half-open spans; spans that touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def solve(blocks: list[bytes], length: int, k: int) -> Iterator[tuple[bytes, int, int]]:
    """Merge the runs of one part and give the repeated spans (text key, start, end) of its anchors.

    Entries carry (least, most, members, keys, positions); members counts anchors, of which some may
    belong to texts that need no answer.
    """
    group: list[list] = []

    def answers() -> Iterator[tuple[bytes, int, int]]:
        if len(group) == 1 and group[0][5] < 2:
            return
        offsets = repeated_offsets([(g[0], g[1], g[2]) for g in group], length) if len(group) > 1 else [[]]
        for g, found in zip(group, offsets):
            _, _, _, least, most, members, ids = g
            if members > 1:
                found = [(least, most)]
            for lo, hi in union([(max(a, least), min(b, most) + 1) for a, b in found if max(a, least) <= min(b, most)]):
                for key, at in ids:
                    yield key, at - hi + 1, at - lo + length

    for shared, right, left, least, most, members, ids in merge([read_run(b) for b in blocks]):
        if group and shared < k:
            yield from answers()
            group = []
        if group and shared == len(right) == len(group[-1][1]) and left == group[-1][2]:
            group[-1][5] += members
            group[-1][6] += ids
        else:
            group.append([shared, right, left, least, most, members, list(ids)])
    if group:
        yield from answers()


def text_key(text: str = "text") -> Column:
    """SHA-256 of the text's bytes; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))


class Repeats:
    """Repeated passages of at least `length` bytes in a table of texts.

    `affected`: one row for each distinct text that loses bytes: key, kept (the remaining bytes),
    n_removed, n_spans and spans (start and end of maximal removed runs, in bytes). Rows of the
    table find theirs by `text_key`. Null texts count as empty; rows that repeat a text, whether or
    not they repeat its id, are copies that lose everything from `length` bytes on; an empty table
    affects nothing. Columns besides the text are not read.
    """

    def __init__(self, df: DataFrame, scratch: Scratch, length: int = 200, text: str = "text", hot: int = HOT):
        self.scratch, self.spark, self.length, self.k = scratch, df.sparkSession, length, max(4, length // 4)
        docs = df.select(text_key(text).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).filter(F.octet_length("text") >= length)
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.buckets = partitions_for(size, BUCKET_BYTES, self.spark)
        self.name = f"repeats_{uuid.uuid4().hex}"
        distinct = docs.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
        distinct.repartition(self.buckets, "key").write.option("compression", "zstd").bucketBy(self.buckets, "key").saveAsTable(self.name)
        scratch.tidy()
        self.affected = scratch.cut(self._apply(self._spans(hot)))
        self.spark.sql(f"DROP TABLE {self.name}")

    def _texts(self) -> DataFrame:
        return self.spark.table(self.name)

    def _spans(self, hot: int) -> DataFrame:
        length, k = self.length, self.k

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    part = b.slice(at, 1000)
                    number, position, least, most, h = anchors([x.as_buffer().to_pybytes() for x in part.column(1)], length, k)
                    if len(number):
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(number)), pa.array(position.astype(np.int64)), pa.array(least.astype(np.int16)), pa.array(most.astype(np.int16)), pa.array(h.view(np.int64))], names=["key", "position", "least", "most", "gram"])

        placed = self.scratch.cut(self._texts().select("key", "text").mapInArrow(place, "key binary, position long, least short, most short, gram long"))
        # written, so that the join below meets two plain exchanges and Spark can split a frequent gram
        counts = self.scratch.cut(placed.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        lists = placed.join(counts, "gram").groupBy("key").agg(F.collect_list(F.struct("position", "least", "most", "gram", (F.col("n") > hot).alias("hot"))).alias("at"))
        work = self.scratch.cut(lists)
        total = work.agg(F.sum(F.size("at")), F.sum(F.size(F.filter("at", lambda x: x["hot"])))).first()
        parts = partitions_for(total[0] or 0, MERGE, self.spark)
        joined = self._texts().join(work, "key").select("key", "text", (F.col("copies") > 1).alias("whole"), "at")

        def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []

            def flush() -> Iterator[pa.RecordBatch]:
                held.sort(key=lambda e: (e[0], e[1], e[2]))
                rows: dict[int, list[tuple]] = {}
                for part, right, left, least, most, ids in held:
                    own = rows.setdefault(part, [])
                    if own and own[-1][0] == right and own[-1][1] == left:
                        last = own[-1]
                        own[-1] = (right, left, least, most, last[4] + 1, last[5] + ids)
                    else:
                        own.append((right, left, least, most, 1, ids))
                held.clear()
                if rows:
                    yield pa.RecordBatch.from_pydict({"part": pa.array(list(rows), pa.int32()), "run": pa.array([front_code(x) for x in rows.values()], pa.binary())})

            for b in batches:
                for key, text, whole, at in zip(*(b.column(i) for i in range(4))):
                    key, data, whole = key.as_py(), text.as_buffer().to_pybytes(), whole.as_py()
                    for x in at.as_py():
                        if x["hot"]:
                            continue
                        p = x["position"]
                        left = data[p - x["most"] : p][::-1]
                        held.append((x["gram"] % parts, data[p : p + length], left, x["least"], x["most"], [] if whole else [(key, p)]))
                    if len(held) >= RUN:
                        yield from flush()
            yield from flush()

        def merged(group: pa.Table) -> pa.Table:
            found = list(solve(group["run"].to_pylist(), length, k))
            return pa.table({"key": pa.array([x[0] for x in found], pa.binary()), "start": pa.array([x[1] for x in found], pa.int64()), "end": pa.array([x[2] for x in found], pa.int64())})

        spans = joined.mapInArrow(runs, "part int, run binary").groupBy("part").applyInArrow(merged, "key binary, start long, end long")
        if not total[1]:
            return spans

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for key, text, whole, at in zip(*(b.column(i) for i in range(4))):
                    key, data = key.as_py(), text.as_buffer().to_pybytes()
                    starts = [x["position"] - o for x in at.as_py() if x["hot"] for o in range(x["least"], x["most"] + 1)]
                    for i in range(0, len(starts), 20_000):
                        own = starts[i : i + 20_000]
                        yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(own), pa.binary()), "start": pa.array(own, pa.int64()), "window": pa.array([hashlib.md5(data[s : s + length]).digest() for s in own], pa.binary())})

        seen = self.scratch.cut(joined.mapInArrow(windows, "key binary, start long, window binary"))
        again = self.scratch.cut(seen.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        return spans.union(seen.join(again, "window").select("key", "start", (F.col("start") + length).alias("end")))

    def _apply(self, spans: DataFrame) -> DataFrame:
        lists = spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("found"))
        rows = self._texts().join(lists, "key", "left").filter("copies > 1 OR found IS NOT NULL").select("key", "text", (F.col("copies") > 1).alias("whole"), "found")

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 500):
                    out: dict[str, list] = {c: [] for c in ("key", "kept", "n_removed", "n_spans", "spans")}
                    for key, text, whole, found in zip(*(b.column(i).slice(at, 500) for i in range(4))):
                        data = text.as_buffer().to_pybytes()
                        own = [(0, len(data))] if whole.as_py() else union([(x["start"], x["end"]) for x in found.as_py() or []])
                        kept, last = [], 0
                        for s, e in own:
                            kept.append(data[last:s])
                            last = e
                        kept.append(data[last:])
                        for c, v in zip(out, (key.as_py(), b"".join(kept), sum(e - s for s, e in own), len(own), [{"start": s, "end": e} for s, e in own])):
                            out[c].append(v)
                    types = {"key": pa.binary(), "kept": pa.binary(), "n_removed": pa.int64(), "n_spans": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
                    yield pa.RecordBatch.from_pydict({c: pa.array(v, types[c]) for c, v in out.items()})

        return rows.mapInArrow(keep, "key binary, kept binary, n_removed long, n_spans long, spans array<struct<start:long,end:long>>")
