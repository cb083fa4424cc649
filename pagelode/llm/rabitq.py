"""Embedding near-duplicates with randomised-rotation binary codes.

A unit vector is rotated by random orthogonal matrices; the code is the signs, and one correction
factor per rotation (how well the signs stand for the vector) is stored with it. A code and a
factor give an unbiased estimate of the inner product with any vector, and the factor bounds its
error. Pairs come from agreement on random subsets of code bits; pairs whose upper confidence bound
stays below the threshold are dropped, all others are computed exactly, and only the exact cosine
makes a link.

Links needed to connect a group come out of each subset bucket, not all its pairs; how many links
each vector has is counted within the connected groups, block by block. Large buckets and groups
are cut into blocks, and every pair of blocks is work of its own. Vectors of each length have
rotations of their own and meet only each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.components import connected
from pagelode.llm.shared import Scratch, partitions_for
from pagelode.llm.vectors import block, by_length, lengths, usable

ROTATIONS = 4
#: Width of the confidence bounds in units of the estimate's error scale.
EPSILON = 5.0
#: Share of pairs at the threshold that may meet in no subset.
MISSED = 1e-4
#: Vectors in one block of a bucket or group.
BLOCK = 2048
#: Rows that one task compares, on average.
TASK_ROWS = 50_000


class Coder:
    """Random rotations and the subsets of code bits that are compared."""

    def __init__(self, dim: int, bits: int, subsets: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.dim = dim
        self.rotations = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(ROTATIONS)]
        total = ROTATIONS * dim
        self.subsets = np.array([rng.choice(total, min(bits, total), replace=False) for _ in range(subsets)])

    def signs(self, unit: np.ndarray) -> np.ndarray:
        return np.concatenate([unit @ r > 0 for r in self.rotations], axis=1)

    def factors(self, unit: np.ndarray) -> np.ndarray:
        """Inner product of each vector with its code, one for each rotation."""
        return np.stack([np.abs(unit @ r).sum(1) / math.sqrt(self.dim) for r in self.rotations], axis=1)

    def estimator(self, signs: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """Row u of each code such that u . y estimates its vector's inner product with y."""
        s = np.where(signs, 1.0, -1.0).reshape(-1, ROTATIONS, self.dim) / factors[:, :, None]
        return sum(s[:, i] @ r.T for i, r in enumerate(self.rotations)) / (ROTATIONS * math.sqrt(self.dim))

    def margin(self, factors: np.ndarray) -> np.ndarray:
        """Half-width of the confidence interval of the estimates from each code."""
        f2 = np.minimum(factors**2, 1.0)
        return EPSILON * np.sqrt(((1 - f2) / f2).sum(1)) / (ROTATIONS * math.sqrt(max(self.dim - 1, 1)))

    def links(self, cosine: float, node, v, code, factors, side, label) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of linked pairs of one cell, each pair once: estimate, bound, exact cosine."""
        rows, cols = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        for at in range(0, len(rows), 512):
            own = rows[at : at + 512]
            bound = self.estimator(code[own], factors[own]) @ v[cols].T + self.margin(factors[own])[:, None]
            i, j = np.nonzero(bound >= cosine)
            i, j = own[i], cols[j]
            keep = ((side[i] != 2) | (node[i] < node[j])) & (label[i] == label[j])
            i, j = i[keep], j[keep]
            for k in range(0, len(i), 200_000):
                x, y = i[k : k + 200_000], j[k : k + 200_000]
                exact = (v[x] * v[y]).sum(1) >= cosine
                yield x[exact], y[exact]


def plan(dim: int, largest: int, cosine: float) -> tuple[int, int]:
    """Bits of a subset, so that unrelated vectors seldom meet, and how many subsets keep misses rare."""
    bits = min(ROTATIONS * dim, max(8, math.ceil(math.log2(max(largest, 2))) + 4))
    agree = (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISSED) / math.log(max(1 - agree, 1e-300)))) if agree < 1 else 1


def cells(df: DataFrame, sizes: DataFrame, group: str) -> DataFrame:
    """Deal the rows of each group into blocks; a row comes once for every pair of blocks that its own is in.

    Adds cell (the pair of blocks, as one number of the group) and side (0: first block, 1: second,
    2: the block with itself).
    """
    n = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = df.join(sizes, group).withColumn("blocks", n).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a, b = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return dealt.withColumn("cell", F.xxhash64(group, a, b)).withColumn("side", side.cast("int")).drop("n", "blocks", "own", "other")


class Near:
    """Links at `cosine` or more between rows with equal labels."""

    def __init__(self, df: DataFrame, scratch: Scratch, cosine: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"):
        self.scratch, self.cosine = scratch, cosine
        v = F.col(vector)
        valid = df.filter(usable(v) & F.col(label).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), v.cast("array<double>").alias("v"))
        keyed = valid.withColumn("key", self.key(F.col("label"), F.col("v")))
        copies = keyed.groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"))
        self.distinct = scratch.cut(copies.withColumn("node", F.monotonically_increasing_id()))
        self.coders = {dim: Coder(dim, *plan(dim, largest, cosine)) for dim, largest in lengths(self.distinct, "v", "label").items()}

    @staticmethod
    def key(label: Column, v: Column) -> Column:
        """128-bit digest of label and vector."""
        return F.struct(F.xxhash64(label, v).alias("a"), F.xxhash64(F.lit(7), v, label).alias("b"))

    def coded(self) -> DataFrame:
        """node, label, v, copies, dim, code (bits as binary) and factors of every distinct vector."""
        shared = self.scratch.spark.sparkContext.broadcast(self.coders)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for dim, at in by_length(whole.column(2)):
                    b, coder = whole.take(pa.array(at)), shared.value[dim]
                    x = block(b.column(2), dim)
                    unit = x / np.linalg.norm(x, axis=1)[:, None]
                    code = np.packbits(coder.signs(unit), axis=1, bitorder="little")
                    own = [pa.array(np.full(b.num_rows, dim, np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(list(coder.factors(unit)), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays([*b.columns, *own], names=["node", "label", "v", "copies", "dim", "code", "factors"])

        rows = self.distinct.select("node", "label", "v", "copies")
        return self.scratch.cut(rows.mapInArrow(run, "node long, label string, v array<double>, copies long, dim int, code binary, factors array<double>"))

    def compare(self, rows: DataFrame, total: int, work, schema: str) -> DataFrame:
        """Run `work(coder, ids, v, code, factors, copies, side, label)` on every cell; many small cells of one length share a task."""
        parts, shared = partitions_for(total, TASK_ROWS, self.scratch.spark), self.scratch.spark.sparkContext.broadcast(self.coders)

        def run(group: pa.Table) -> pa.Table:
            dim = group["dim"][0].as_py()
            coder, width = shared.value[dim], ROTATIONS * dim
            cell = group["cell"].to_numpy()
            order = np.argsort(cell, kind="stable")
            group, cell = group.take(pa.array(order)), cell[order]
            node, side, copies = (group[c].to_numpy() for c in ("node", "side", "copies"))
            label = group["label"].to_numpy(zero_copy_only=False)
            v = block(group["v"], dim)
            v = v / np.linalg.norm(v, axis=1)[:, None]
            code = np.unpackbits(np.frombuffer(b"".join(group["code"].to_pylist()), np.uint8).reshape(len(node), -1), axis=1, bitorder="little")[:, :width].astype(bool)
            factors = block(group["factors"], ROTATIONS)
            cuts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
            out: list[tuple] = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a > 1:
                    out += work(coder, *(x[a:b] for x in (node, v, code, factors, copies, side, label)))
            return pa.table([pa.array([o[i] for o in out], pa.int64()) for i in range(2)], names=["a", "b"])

        return rows.withColumn("part", F.pmod(F.xxhash64("cell"), F.lit(parts))).groupBy("dim", "part").applyInArrow(run, schema)

    def edges(self, coded: DataFrame) -> DataFrame:
        """Links that connect what is connected within the buckets of equal code bits."""
        shared, cosine = self.scratch.spark.sparkContext.broadcast(self.coders), self.cosine

        def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                dims = whole.column(3).to_numpy()
                for dim in np.unique(dims):
                    b = whole.take(pa.array(np.flatnonzero(dims == dim)))
                    bits = np.unpackbits(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1, bitorder="little")
                    for i, subset in enumerate(shared.value[dim].subsets):
                        packed = np.packbits(bits[:, subset], axis=1)
                        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(np.full(b.num_rows, i, np.int32)), pa.array([p.tobytes() for p in packed], pa.binary())], names=["node", "label", "dim", "subset", "bits"])

        met = coded.select("node", "code", "label", "dim").mapInArrow(bands, "node long, label string, dim int, subset int, bits binary")
        met = self.scratch.cut(met.select("node", F.xxhash64("label", "dim", "subset", "bits").alias("bucket")))
        sizes = self.scratch.cut(met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        total = sizes.agg(F.sum("n")).first()[0] or 0

        def connect(coder, node, v, code, factors, copies, side, label) -> list[tuple]:
            root = list(range(len(node)))

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            out = []
            for x, y in coder.links(cosine, node, v, code, factors, side, label):
                for i, j in zip(x.tolist(), y.tolist()):
                    if (p := find(i)) != (q := find(j)):
                        root[q] = p
                        out.append((int(node[i]), int(node[j])))
            return out

        return self.compare(cells(met, sizes, "bucket").join(coded, "node"), total, connect, "a long, b long")

    def counts(self, coded: DataFrame, roots: DataFrame) -> DataFrame:
        """(node, n): links of every vector of a connected group, copies included."""
        cosine = self.cosine
        sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        total = roots.count()

        def count(coder, node, v, code, factors, copies, side, label) -> list[tuple]:
            n = np.zeros(len(node), np.int64)
            for x, y in coder.links(cosine, node, v, code, factors, side, label):
                np.add.at(n, x, copies[y])
                np.add.at(n, y, copies[x])
            return [(int(a), int(b)) for a, b in zip(node, n) if b]

        done = self.compare(cells(roots, sizes, "root").join(coded, "node"), total, count, "a long, b long")
        return done.groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n"))

    def groups(self) -> DataFrame:
        """key, n_links and component_id (smallest id reachable) of every distinct vector with its label."""
        base = self.distinct.select("node", "key", "first_id", "copies")
        if not self.coders:
            return base.select("key", F.lit(0).cast("long").alias("n_links"), F.col("first_id").alias("component_id"))
        coded = self.coded()
        roots = self.scratch.cut(connected(self.scratch.cut(self.edges(coded)), self.scratch))
        counts = self.counts(coded, roots)
        smallest = roots.join(base, "node").groupBy("root").agg(F.min("first_id").alias("smallest"))
        known = roots.join(smallest, "root").select("node", "smallest")
        return base.join(known, "node", "left").join(counts, "node", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "first_id").alias("component_id"))


def near_duplicates(df: DataFrame, scratch: Scratch, cosine: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept (vec_id = component_id), one row for every row of `df`.

    Vectors that are null, zero or not finite throughout, and rows with a null label, link with
    nothing; vectors link with those of their own length only. Rows that repeat id and vector count as
    further vectors, and a null vec_id never is the smallest of its group. An empty table gives no rows.
    """
    near = Near(df, scratch, cosine, vec_id, vector, label)
    v = F.col(vector)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(usable(v) & F.col(label).isNotNull(), Near.key(F.col(label).cast("string"), v.cast("array<double>"))).alias("key"))
    out = rows.join(scratch.cut(near.groups()), "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
