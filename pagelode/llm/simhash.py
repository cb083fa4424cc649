"""SimHash near-duplicates by generalised pigeonhole search.

Fingerprints are compared only where they can be near: correlated bits are grouped into
partitions, every fingerprint divides the search radius unequally over the partitions by dynamic
programming on estimated candidate counts, probes the values within its own thresholds, and
candidates are verified. If the thresholds t_i of a fingerprint satisfy sum(t_i + 1) = radius + 1,
every other fingerprint within the radius agrees with it up to t_i in some partition (-1: the
partition is not probed), so no link is lost.

Exact copies share a fingerprint and are combined before anything is compared. A fingerprint whose
every allocation is costly sits in a crowd of near copies. For radius 2 there is an exact way with
bounded cost: it announces itself at its 65 neighbours at most one bit away; two such fingerprints
link if and only if they meet at a neighbour, and no neighbour has more than 65 visitors.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelode.llm.components import connected
from pagelode.llm.shared import Scratch, ship

BITS = 64
#: Bytes of a text that are split into words at once.
BLOCK = 4 << 20
#: Estimated candidates and probes beyond which a fingerprint takes the neighbour route.
CROWD = 400
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = (np.arange(8, dtype=np.int64) * 256)[None, :]


def word_blocks(data: bytes, carry: int) -> Iterator[list[bytes]]:
    """Words of a text in blocks; each block begins with the last `carry` words of the one before."""
    at, last = 0, []
    while at < len(data):
        end = len(data)
        if end - at > BLOCK and (m := _SPACE.search(data, at + BLOCK)):
            end = m.start()
        words = last + data[at:end].split()
        yield words
        last = words[-carry:] if carry else []
        at = end


def shingle_hashes(data: bytes, n: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of all runs of n words of lower-cased text, repeats included; fewer words: of all of them."""
    h, seen = xxhash.xxh64_intdigest, False
    short: list[bytes] = []
    for words in word_blocks(data, n - 1):
        short = words
        if len(words) >= n:
            seen = True
            joined = b" ".join(words)
            stops = list(accumulate(map(len, words), lambda a, b: a + b + 1))
            starts = [0, *(x + 1 for x in stops)]
            yield np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, stops[n - 1 :])), np.uint64, len(words) - n + 1)
    if not seen and short:
        yield np.array([h(b" ".join(short), seed)], np.uint64)


def fingerprint(text: str | None, n: int = 3) -> int:
    """64 bits, each 1 if set in over half the shingle hashes; no words: 0."""
    counts, total = np.zeros(2048, np.int64), 0
    for hashes in shingle_hashes((text or "").encode().lower(), n):
        counts += np.bincount((hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048)
        total += len(hashes)
    if not total:
        return 0
    ones = (counts.reshape(8, 256) @ _BIT_OF_BYTE).ravel()
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, words: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp: long) for every row; a null text counts as empty, repeated rows stay."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), words) for x in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bit_statistics(distinct: DataFrame) -> np.ndarray:
    """64 x 64 counts of bits set together over all fingerprints; 4096 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for b in batches:
            x = bits_of(b.column(0).to_numpy()).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"k": np.arange(BITS * BITS, dtype=np.int32), "n": total.ravel()})

    rows = distinct.select("fp").mapInArrow(run, "k int, n double").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS)
    for r in rows:
        out[r["k"]] = r["n"]
    return out.reshape(BITS, BITS)


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(together: np.ndarray, total: int, parts: int) -> list[list[int]]:
    """Partitions of about equal width that keep correlated bits together."""
    p = np.diag(together) / max(total, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / max(total, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts, 0, -1):
        width = -(-len(left) // k)
        group = [max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            group.append(max(left, key=lambda b: (corr[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def gather(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint as one number."""
    x, out = fps.astype(np.int64), np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((x >> b) & 1) << k
    return out


@functools.lru_cache(maxsize=64)
def ball(width: int, radius: int) -> np.ndarray:
    """All masks of up to `radius` bits."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.int64)


def allocate(cost: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds with sum(t + 1) = radius + 1 and least cost, for many fingerprints at once.

    cost[i, t + 1]: cost of threshold t in partition i, one column per fingerprint.
    """
    parts, _, n = cost.shape
    best = np.full((radius + 2, n), np.inf)
    best[0] = 0
    choice = np.zeros((parts, radius + 2, n), np.int8)
    for i in range(parts):
        new = np.full_like(best, np.inf)
        for used in range(radius + 2):
            for take in range(used + 1):
                c = best[used - take] + cost[i, take]
                better = c < new[used]
                new[used][better] = c[better]
                choice[i, used][better] = take
        best = new
    left, out = np.full(n, radius + 1), np.zeros((parts, n), np.int8)
    for i in range(parts - 1, -1, -1):
        out[i] = choice[i, left, np.arange(n)]
        left = left - out[i]
    return out - 1, best[radius + 1]


def near_pairs(distinct: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp) at most `radius` bits apart.

    Every edge is a real link. Outside crowds each link is an edge; within a crowd of radius 2
    enough of them are given to keep everything connected that is connected.
    """
    spark = distinct.sparkSession
    total, parts = distinct.count(), radius + 1
    groups = group_bits(bit_statistics(distinct), total, parts)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy()
            for i, g in enumerate(groups):
                yield pa.RecordBatch.from_pydict({"fp": fps, "part": np.full(len(fps), i, np.int32), "value": gather(fps, g)})

    index = scratch.cut(distinct.select("fp").mapInArrow(values, "fp long, part int, value long"))
    counted = index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    mine = index.join(counted, ["part", "value"]).groupBy("fp").agg(*(F.max(F.when(F.col("part") == i, F.col("n"))).alias(f"n{i}") for i in range(parts)))
    half = [len(g) // 2 for g in groups]
    low = F.expr("CASE part " + " ".join(f"WHEN {i} THEN {(1 << h) - 1}L" for i, h in enumerate(half)) + " END")
    sides = index.select("part", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("value").bitwiseAND(low).alias("v")), F.struct(F.lit(1).alias("side"), F.col("value").bitwiseAND(F.bitwise_not(low)).alias("v")))).alias("x"))
    table = [[np.zeros(1 << half[i]), np.zeros(1 << (len(g) - half[i]))] for i, g in enumerate(groups)]
    for r in sides.groupBy("part", "x.side", "x.v").count().collect():  # at most 2 ** 11 values for each half of a partition
        i = r["part"]
        table[i][r["side"]][r["v"] >> (half[i] if r["side"] else 0)] = r["count"]

    def within(counts: np.ndarray, t: int) -> np.ndarray:
        """For every value of a half: fingerprints whose half is at most t bits away."""
        v = np.arange(len(counts))
        return sum(counts[v ^ m] for m in ball(len(counts).bit_length() - 1, t))

    near = [[[within(side, t) for t in range(radius + 1)] for side in pair] for pair in table]
    shared = spark.sparkContext.broadcast(near)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = shared.value
        for b in batches:
            fps = b.column(0).to_numpy()
            exact = [b.column(1 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(parts)]
            own = [gather(fps, g) for g in groups]
            cost = np.zeros((parts, radius + 2, len(fps)))
            for i, g in enumerate(groups):
                a, c = own[i] & ((1 << half[i]) - 1), own[i] >> half[i]
                for t in range(radius + 1):
                    # halves taken as independent; what is known exactly is never estimated lower
                    est = sum((near[i][0][s][a] - (near[i][0][s - 1][a] if s else 0)) * near[i][1][t - s][c] for s in range(t + 1)) / max(total, 1)
                    cost[i, t + 1] = np.maximum(est, exact[i]) + len(ball(len(g), t))
            chosen, least = allocate(cost, radius)
            crowd = (least > CROWD) & (radius == 2)
            for i, g in enumerate(groups):
                for t in range(radius + 1):
                    at = np.flatnonzero((chosen[i] == t) & ~crowd)
                    masks = ball(len(g), t)
                    for k in range(0, len(at), max(1, 200_000 // len(masks))):
                        pick = at[k : k + max(1, 200_000 // len(masks))]
                        v = (own[i][pick][:, None] ^ masks[None]).ravel()
                        yield pa.RecordBatch.from_pydict({"fp": np.repeat(fps[pick], len(masks)), "part": np.full(len(v), i, np.int32), "value": v})
            at, one = np.flatnonzero(crowd), np.concatenate([[0], np.left_shift(np.uint64(1), np.arange(BITS, dtype=np.uint64)).view(np.int64)]).astype(np.int64)
            for k in range(0, len(at), 2000):
                pick = at[k : k + 2000]
                v = (fps[pick][:, None] ^ one[None]).ravel()
                yield pa.RecordBatch.from_pydict({"fp": np.repeat(fps[pick], len(one)), "part": np.full(len(v), -1, np.int32), "value": v})

    asked = scratch.cut(mine.select("fp", *(f"n{i}" for i in range(parts))).mapInArrow(probes, "fp long, part int, value long"))
    crowded = asked.filter("part = -1 AND value = fp").select("fp", F.lit(True).alias("crowd"))
    marked = index.join(crowded, "fp", "left")
    pairs = (
        asked.filter("part >= 0").select(F.col("fp").alias("a"), "part", "value")
        .join(marked.withColumnRenamed("fp", "b"), ["part", "value"])
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, radius) & (F.col("crowd").isNotNull() | (F.col("a") < F.col("b"))))
        .select("a", "b")
    )
    meeting = asked.filter("part = -1").select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("value")).alias("b")).filter("a != b")
    return pairs.union(meeting)


def near_duplicates(df: DataFrame, scratch: Scratch, words: int = 3, radius: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links.

    A null text counts as empty: fingerprint 0, linked like any other. Rows that repeat a doc_id
    are rows of their own. An empty table gives no rows.
    """
    docs = scratch.cut(fingerprints(df, words, text, doc_id))
    distinct = scratch.cut(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = scratch.cut(connected(near_pairs(distinct, radius, scratch), scratch))
    named = roots.join(distinct.withColumnRenamed("fp", "node"), "node")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    members = roots.join(smallest, "root").select(F.col("node").alias("fp"), "component_id")
    ids = scratch.cut(distinct.join(members, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")))
    return docs.join(ids, "fp").select("doc_id", "fp", "component_id")
