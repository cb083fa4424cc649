"""Nearest neighbours by multi-index hashing of learned, rotated binary codes.

The rotation is learned on a bounded sample (principal axes, then iterative quantisation). Every
vector gets a 64-bit code, split into substrings that are indexed one by one. By the pigeonhole
principle a code within Hamming radius r of a query's differs from it in some substring by no more
than that substring's share of r, so probing every substring within its share retrieves all codes
within r; the floats of those are then ranked exactly. The radius is calibrated on the sample: the
smallest that covers the wanted share of true neighbours there, which are farther away than those
in the whole table. A query that finds too few widens its radius until it has enough.

Equal vectors are one entry of the index with their smallest ids. Vectors of each length have a
rotation, a radius and an index of their own. An index is dealt into shards, and blocks of queries of
its length meet every shard; each pair of a shard and a query block is one task's work and yields the
best few per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelode.llm.shared import Scratch
from pagelode.llm.simhash import ball
from pagelode.llm.vectors import block, lengths, usable

BITS, PARTS = 64, 4
WIDTH = BITS // PARTS
#: Vectors that the rotation and the radius are learned from, at most.
SAMPLE = 8000
#: Share of true neighbours within the radius, on the sample.
COVERED = 0.97
SHARD_ROWS = 16_384
QUERY_ROWS = 8_192


class Coder:
    """mean, rotation (dim x 64) and the search radius."""

    def __init__(self, mean: np.ndarray, rotation: np.ndarray, radius: int):
        self.mean, self.rotation, self.radius = mean, rotation, radius

    def codes(self, x: np.ndarray) -> np.ndarray:
        bits = (x - self.mean) @ self.rotation > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def learn(x: np.ndarray, k: int = 10, rounds: int = 30, seed: int = 5) -> Coder:
    """Principal axes, repeated with random rotations where there are fewer than 64, then iterative quantisation of each set."""
    rng, dim = np.random.default_rng(seed), x.shape[1]
    mean = x.mean(0) if len(x) else np.zeros(dim)
    c = x - mean
    axes = np.linalg.svd(c, full_matrices=False)[2][:BITS].T if len(x) > 1 else np.eye(dim)[:, :BITS]
    sets, have = [], 0
    while have < BITS:
        w = axes.shape[1]
        v = c @ axes
        r = np.linalg.qr(rng.normal(size=(w, w)))[0]
        for _ in range(rounds if len(x) > w else 0):
            u, _, t = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ t).T
        sets.append(axes @ r)
        have += w
    coder = Coder(mean, np.concatenate(sets, 1)[:, :BITS], BITS)
    if len(x) > 20 * k:
        codes, q = coder.codes(x), rng.choice(len(x), min(400, len(x)), replace=False)
        d = ((x[q] ** 2).sum(1))[:, None] - 2 * x[q] @ x.T + (x**2).sum(1)[None]
        d[np.arange(len(q)), q] = np.inf
        near = np.argpartition(d, k, axis=1)[:, :k]
        apart = np.bitwise_count(codes[q][:, None] ^ codes[near]).ravel()
        coder.radius = int(np.quantile(apart, COVERED, method="higher"))
    return coder


def shares(radius: int) -> list[int]:
    """Radius of each substring: with radius = s * PARTS + a, the first a + 1 get s, the others s - 1 (-1: not probed)."""
    s, a = divmod(min(radius, BITS), PARTS)
    return [min(s, WIDTH) if i <= a else min(s, WIDTH) - 1 for i in range(PARTS)]


class Index:
    """The substring tables of one shard."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for i in range(PARTS):
            own = ((codes >> np.uint64(WIDTH * i)) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            self.tables.append((order, np.searchsorted(own[order], np.arange((1 << WIDTH) + 1))))

    def within(self, code: int, radius: int) -> np.ndarray:
        """Numbers of all codes at most `radius` bits from `code`."""
        hit = np.zeros(len(self.codes), bool)
        for i, share in enumerate(shares(radius)):
            if share < 0:
                continue
            order, starts = self.tables[i]
            probe = ((code >> (WIDTH * i)) & ((1 << WIDTH) - 1)) ^ ball(WIDTH, share)
            first, n = starts[probe], starts[probe + 1] - starts[probe]
            first, n = first[n > 0], n[n > 0]
            at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            hit[order[at]] = True
        found = np.flatnonzero(hit)
        return found[np.bitwise_count(self.codes[found] ^ np.uint64(code)) <= radius]


def search(df: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", coders: dict[int, Coder] | None = None) -> DataFrame:
    """The k nearest rows of `df` that each row of `queries` finds: query_id, rank, vec_id, score.

    Both frames have ids and vectors; a row with the query's own id is no candidate. Nearness is
    Euclidean distance in double precision, ties go to the smaller id. Rows whose vectors are null,
    zero or not finite throughout take no part, nor do rows with a null id; a query's candidates are
    the vectors of its own length. Repeated rows of one id count once as candidates and once as
    queries for each different vector. All columns but these two are left alone. `coders` may give
    rotation and radius of a length; those of the others are learned.
    """
    ok = usable(F.col(vector)) & F.col(vec_id).isNotNull()
    both = [f.filter(ok).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).distinct().withColumn("dim", F.size("v")) for f in (df, queries)]
    rows, asked = (scratch.cut(f) for f in both)
    coders = dict(coders or {})
    for dim in sorted(set(lengths(rows, "v")) - set(coders)):
        picked = rows.filter(F.col("dim") == dim).select("v").orderBy(F.xxhash64("id", "v")).limit(SAMPLE).collect()
        coders[dim] = learn(np.array([r["v"] for r in picked]).reshape(-1, dim), k)
    # of equal vectors only the k + 1 smallest ids can be among a query's k nearest
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    entries = scratch.cut(first.groupBy("dim", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    pieces = lambda f, size, name: f.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    cells = scratch.cut(pieces(entries, SHARD_ROWS, "shards").join(pieces(asked, QUERY_ROWS, "blocks"), "dim"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = entries.join(cells, "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int")).withColumn("block", every("blocks")).drop("shards", "blocks")
    right = asked.join(scratch.cut(cells), "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("shard", every("shards")).drop("shards", "blocks")
    shared = scratch.spark.sparkContext.broadcast(coders)

    def meet(entries: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if entries.num_rows and asked.num_rows:
            dim = entries["dim"][0].as_py()
            c = shared.value[dim]
            x, q = block(entries["v"], dim), block(asked["v"], dim)
            ids, index = entries["ids"].to_pylist(), Index(c.codes(x))
            members = np.array([len(i) for i in ids])
            for own, v, code in zip(asked["id"].to_pylist(), q, c.codes(q)):
                radius = c.radius
                found = index.within(int(code), radius)
                while members[found].sum() < k + 1 and radius < BITS:
                    radius += PARTS
                    found = index.within(int(code), radius)
                d = np.sqrt(((x[found] - v) ** 2).sum(1))
                if len(d) > k + 1:
                    edge = np.partition(d, k)[k]
                    found, d = found[d <= edge], d[d <= edge]
                best = sorted((s, i) for s, f in zip(d.tolist(), found.tolist()) for i in ids[f] if i != own)
                seen: set[int] = set()
                for s, i in best:
                    if len(seen) == k:
                        break
                    if i not in seen:
                        seen.add(i)
                        out.append((own, i, s))
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    found = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block")).applyInArrow(meet, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
