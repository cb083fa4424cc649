"""Near-duplicates at a wanted similarity of shingle sets: SimHash finds candidates, the sets decide.

At a shingle similarity of 0.8 two 64-bit fingerprints differ in ten bits on average and up to
sixteen; pigeonhole search at such a radius probes about a hundredth of all pairs. So this form
takes wider fingerprints (1024 bits) and many partitions of bits with threshold zero. A pair at
the wanted similarity meets in none of them with probability `MISSED`, one above it far less often.

The generalised pigeonhole search of `simhash` goes first, on the first 64 bits at radius `FIRST`: of
the pairs it finds, those whose sets are similar enough are links. Texts that these connect are never
compared again, so a crowd of near copies does not meet in every partition.

Repeats of a shingle in a text count once, and texts with equal sets are combined beforehand.
Documents that meet are first compared on 64 bits; where one has a plausible partner, and only there,
it is compared on its whole fingerprint, within a radius so wide that it turns down hardly any pair that is similar
enough. Texts of few shingles flip more bits, so they take more partitions. Only where a candidate is left do the shingle sets themselves go to its bucket, each pair to the first in
which it meets; a link is a pair whose sets have the wanted Jaccard similarity, counted exactly. Only
links that connect what is not yet connected leave a bucket. Large buckets are cut into blocks and every pair of
blocks is work of its own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelode.llm.components import connected
from pagelode.llm.shared import Scratch, partitions_for, ship
from pagelode.llm.simhash import near_pairs, shingle_hashes

LANES = 16
BITS = 64 * LANES
#: Share of pairs at the wanted similarity that may meet in no partition.
MISSED = 0.02
#: Bits that a candidate may differ in beyond the expected number, in standard deviations. Sets of a
#: few shingles flip more bits than expected (4 in 5 shingles: 192 instead of 155), hence the wide SLACK.
SLACK, PLAUSIBLE = 7.0, 3.2
#: Sets of up to so many shingles flip up to this share of bits at the wanted similarity (4 in 5: 0.1875);
#: they take as many partitions as that asks for, and more differing bits of the first 64 are plausible.
SHORT, SHORT_FLIPS = 30, 0.19
BLOCK = 1024
TASK_ROWS = 300_000
#: Bytes of shingle sets in a block and in a task.
BLOCK_BYTES, TASK_BYTES = 16 << 20, 48 << 20
#: Differing bits of the first 64 up to which the generalised pigeonhole search finds pairs.
FIRST = 2
_SALT = (np.arange(LANES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
_AT = (np.arange(8 * LANES, dtype=np.int64) * 256)[None, :]
_BIT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float32)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct shingle hashes of a text in rising order; a text of fewer words is one shingle, none without words."""
    out = np.zeros(0, np.uint64)
    for hashes in shingle_hashes((text or "").encode().lower(), words):
        out = np.union1d(out, hashes) if len(out) else np.unique(hashes)
    return out


def wide_fingerprint(shingles: np.ndarray) -> bytes:
    """1024 bits, each 1 if set in over half the lanes' hashes of distinct shingles; all zero without any."""
    counts = np.zeros(2048 * LANES, np.int64)
    for k in range(0, len(shingles), 4096):
        h = shingles[k : k + 4096, None] + _SALT
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        counts += np.bincount((h.astype("<u8").view(np.uint8).reshape(len(h), -1) + _AT).ravel(), minlength=len(counts))
    ones = counts.reshape(-1, 256).astype(np.float32) @ _BIT
    return np.packbits(2 * ones.ravel() > len(shingles), bitorder="little").tobytes()


def similar_sets(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    """Whether two sorted sets have a Jaccard similarity of `least` or more."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common * least.denominator >= least.numerator * (len(a) + len(b) - common)


def flips(similarity: float) -> float:
    """Expected share of differing bits at a Jaccard similarity of the shingles."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def pairs_in_cells(cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with equal cells (rows sorted by cell), by growing distance, vectorised over all cells."""
    i = np.arange(len(cell))
    step = 1
    while len(i := i[i + step < len(cell)]):
        i = i[cell[i] == cell[i + step]]
        yield i, i + step
        step += 1


def in_cells(rows: DataFrame, parts: int, work, schema: str, weight: str | None = None) -> DataFrame:
    """Deal rows (bucket, node, ...) into cells of at most two blocks and run `work(table sorted by cell, cells)` on many cells a task.

    `weight` names a column of bytes; blocks then keep to `BLOCK_BYTES` as well.
    """
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK)
    if weight:
        blocks = F.greatest(blocks, F.ceil(F.sum(weight) / BLOCK_BYTES))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), blocks.cast("int").alias("n")).filter("rows > 1").drop("rows")
    dealt = rows.join(sizes, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cells = dealt.withColumn("cell", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))).drop("n", "own", "other")

    def run(group: pa.Table) -> pa.Table:
        cell = group["cell"].to_numpy()
        order = np.argsort(cell, kind="stable")
        return work(group.take(pa.array(order)), cell[order])

    return cells.withColumn("part", F.pmod(F.xxhash64("cell"), F.lit(parts))).groupBy("part").applyInArrow(run, schema)


def with_node(places: DataFrame, values: DataFrame) -> DataFrame:
    """Attach what a node has to all its places (bucket, subset): one row a node is joined, however many places it has."""
    listed = places.groupBy("node").agg(F.collect_list(F.struct("bucket", "subset")).alias("at"))  # at most one a subset
    return listed.join(values, "node").withColumn("at", F.explode("at")).select("at.*", *values.columns)


def first_of_code(distinct: DataFrame) -> DataFrame:
    """(node, code, rep): the first 64 bits of a node and the smallest node that has the same."""
    rows = distinct.select("node", F.conv(F.hex(F.substring("fp", 1, 8)), 16, -10).cast("long").alias("code"))
    return rows.join(rows.groupBy("code").agg(F.min("node").alias("rep")), "code")


def groups(df: DataFrame, scratch: Scratch, words: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, component_id): component_id is the smallest doc_id reachable over links.

    A null text counts as empty; texts without words are alike. Rows that repeat a doc_id are rows
    of their own. An empty table gives no rows.
    """
    ship(df.sparkSession)

    given = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("key", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = (shingle_set(x.as_py(), words) for x in b.column(1))
            made = [(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), wide_fingerprint(x), 8 * len(x)) for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array([m[i] for m in made], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.int64())))], names=["doc_id", "key", "digest", "fp", "bytes"])

    docs = scratch.cut(given.mapInArrow(prints, "doc_id long, key binary, digest binary, fp binary, bytes long"))
    one_of = F.min(F.struct(F.isnull("doc_id"), "doc_id", "key")).alias("one")
    distinct = docs.groupBy("digest").agg(F.min("doc_id").alias("first_id"), one_of, F.first("fp").alias("fp"), F.first("bytes").alias("bytes"))
    distinct = scratch.cut(distinct.select("digest", "first_id", F.col("one.doc_id").alias("one_id"), F.col("one.key").alias("one_key"), "fp", "bytes").withColumn("node", F.monotonically_increasing_id()))
    n = distinct.count()
    p = flips(similarity)
    bits = max(12, math.ceil(math.log2(max(n, 2))))
    needed = lambda share: math.ceil(math.log(MISSED) / math.log(1 - (1 - share) ** bits))
    common, subsets = needed(p), needed(max(p, SHORT_FLIPS))
    rng = np.random.default_rng(9)
    chosen = [rng.choice(BITS, bits, replace=False) for _ in range(subsets)]
    masks = np.zeros((subsets, BITS), np.uint8)
    for mask, subset in zip(masks, chosen):
        mask[subset] = 1
    masks = np.packbits(masks, axis=1, bitorder="little").view("<u8")
    least = Fraction(str(similarity))
    near = int(BITS * p + SLACK * math.sqrt(BITS * p * (1 - p)))
    plausible, short_plausible = (int(64 * q + PLAUSIBLE * math.sqrt(64 * q * (1 - q))) for q in (p, max(p, SHORT_FLIPS)))

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(x.as_py(), words).tobytes() for x in b.column(1)], pa.binary())], names=["node", "set"])

    def sets_of(nodes: DataFrame) -> DataFrame:
        """One text's set for each node; joined by row, so that copies of a text are no busy key."""
        wanted = distinct.join(nodes.select("node").distinct(), "node").select("node", "one_id", "one_key")
        texts = given.join(wanted, F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("key") == F.col("one_key"))).select("node", "text")
        return scratch.cut(texts.mapInArrow(as_sets, "node long, set binary").groupBy("node").agg(F.first("set").alias("set")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = ([np.frombuffer(x.as_py(), np.uint64) for x in b.column(k)] for k in (2, 3))
            ok = pa.array([similar_sets(x, y, least) for x, y in zip(*sets)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        sided = lambda k: sets.select(F.col("node").alias(k), F.col("set").alias(f"{k}_set"))
        return pairs.join(sided("a"), "a").join(sided("b"), "b").select("a", "b", "a_set", "b_set").mapInArrow(verify, "a long, b long")

    # Generalised pigeonhole first: each node with the first of its own 64 bits, and those that are near each other.
    coded = scratch.cut(first_of_code(distinct))
    one_each = scratch.cut(coded.filter("node = rep").select(F.col("code").alias("fp"), "node"))
    ends = lambda k: one_each.select(F.col("fp").alias(k), F.col("node").alias(f"{k}_node"))
    across = near_pairs(one_each.select("fp"), FIRST, scratch).join(ends("a"), "a").join(ends("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    found = scratch.cut(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(coded.filter("node != rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))).distinct())
    close_sets = sets_of(found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node"))))
    # A pair for each text, then those of the rest that still connect anything.
    tried = scratch.cut(verified(found.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), close_sets))
    near_root = scratch.cut(connected(tried, scratch))
    rooted = lambda rows, k: rows.join(near_root.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root")), k, "left").withColumn(f"{k}_root", F.coalesce(f"{k}_root", k))
    apart = rooted(rooted(found, "a"), "b").filter("a_root != b_root").select("a", "b")
    close = scratch.cut(tried.union(verified(apart, close_sets)))
    near_root = scratch.cut(connected(close, scratch))
    linked = scratch.cut(rooted(distinct.select("node", "fp", "bytes"), "node").withColumnRenamed("node_root", "root"))

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.left_shift(np.int64(1), np.arange(bits, dtype=np.int64))
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                raw = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, BITS // 8)
                node, root, short = part.column(0).to_numpy(), part.column(3).to_numpy(), part.column(2).to_numpy() <= 8 * SHORT
                on, code = np.unpackbits(raw, axis=1, bitorder="little"), np.ascontiguousarray(raw[:, :8]).view("<i8").ravel()
                for i, subset in enumerate(chosen):
                    own = short if i >= common else np.ones(len(code), bool)
                    value = on[own][:, subset].astype(np.int64) @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(root[own]), pa.array(code[own]), pa.array(short[own]), pa.array(np.full(own.sum(), i, np.int32)), pa.array(value)], names=["node", "root", "code", "short", "subset", "value"])

    bucket = F.xxhash64("subset", "value").alias("bucket")
    spread = linked.select("node", "fp", "bytes", "root").mapInArrow(bands, "node long, root long, code long, short boolean, subset int, value long").select(bucket, "subset", "node", "root", "code", "short")

    def partners(group: pa.Table, cell: np.ndarray) -> pa.Table:
        code, short, root = group["code"].to_numpy().view(np.uint64), group["short"].to_numpy(), group["root"].to_numpy()
        has = np.zeros(len(code), bool)
        for i, j in pairs_in_cells(cell):
            close = (root[i] != root[j]) & (np.bitwise_count(code[i] ^ code[j]) <= np.where(short[i] & short[j], short_plausible, plausible))
            has[i[close]] = has[j[close]] = True
        return group.select(["bucket", "subset", "node"]).filter(pa.array(has))

    rows_in = lambda total: partitions_for(total, TASK_ROWS, df.sparkSession)
    some = scratch.cut(in_cells(spread, rows_in(n * common), partners, "bucket long, subset int, node long").distinct())
    known = scratch.cut(some.select("node").distinct().join(linked, "node"))

    def candidates(group: pa.Table, cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different roots within the radius that meet in no subset before this one."""
        fp = np.frombuffer(b"".join(group["fp"].to_pylist()), "<u8").reshape(-1, LANES)
        subset, root = group["subset"].to_numpy(), group["root"].to_numpy()
        for i, j in pairs_in_cells(cell):
            for k in range(0, len(i), 100_000):
                a, b = i[k : k + 100_000], j[k : k + 100_000]
                differ = fp[a] ^ fp[b]
                new = np.flatnonzero((np.bitwise_count(differ).sum(1) <= near) & (root[a] != root[b]))
                before = subset[a]
                for t in range(int(before[new].max(initial=0))):
                    met = ((differ[new] & masks[t]) == 0).all(1) & (before[new] > t)
                    new = new[~met]
                if len(new):
                    yield a[new], b[new]

    def meetings(group: pa.Table, cell: np.ndarray) -> pa.Table:
        has = np.zeros(len(cell), bool)
        for i, j in candidates(group, cell):
            has[i] = has[j] = True
        return group.select(["bucket", "subset", "node"]).filter(pa.array(has))

    full = with_node(some, known.select("node", "root", "fp"))
    met = scratch.cut(in_cells(full, rows_in(some.count()), meetings, "bucket long, subset int, node long").distinct())

    sets = sets_of(met)
    sized = with_node(met, known.select("node", "bytes"))
    heavy = sized.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("w")).select((F.col("w") * F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("w") / BLOCK_BYTES))).alias("w"))
    parts = max(rows_in(met.count()), -(-int(heavy.agg(F.sum("w")).first()[0] or 0) // TASK_BYTES))

    def links(group: pa.Table, cell: np.ndarray) -> pa.Table:
        node, size = group["node"].to_numpy(), group["bytes"].to_numpy() // 8
        own = [np.frombuffer(x, np.uint64) for x in group["set"].to_pylist()]
        held: dict[int, int] = {}
        out: list[tuple[int, int]] = []

        def find(x: int) -> int:
            while (y := held.get(x, x)) != x:
                held[x] = held.get(y, y)
                x = y
            return x

        for i, j in candidates(group, cell):
            fits = np.minimum(size[i], size[j]) * least.denominator >= np.maximum(size[i], size[j]) * least.numerator
            for a, b in zip(i[fits].tolist(), j[fits].tolist()):
                x, y = int(node[a]), int(node[b])
                if (p := find(x)) != (q := find(y)) and similar_sets(own[a], own[b], least):
                    held[q] = p
                    out.append((x, y))
        return pa.table([pa.array([o[i] for o in out], pa.int64()) for i in range(2)], names=["a", "b"])

    whole = with_node(met, known.select("node", "root", "fp", "bytes").join(sets, "node"))
    far = in_cells(whole, parts, links, "a long, b long", weight="bytes")
    roots = scratch.cut(connected(close.union(far), scratch))
    smallest = roots.join(distinct, "node").groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = roots.join(smallest, "root").select("node", "component_id")
    ids = scratch.cut(distinct.join(named, "node", "left").select("digest", F.coalesce("component_id", "first_id").alias("component_id")))
    return docs.select("doc_id", "digest").join(ids, "digest").select("doc_id", "component_id")


def keep_one(df: DataFrame, scratch: Scratch, words: int = 5, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of `df` without near copies: of every group the row with the smallest doc_id stays.

    Rows that repeat a doc_id count as copies of one document; the one that is first by a hash of its
    text stays. A row without doc_id cannot be told from others and stays.
    """
    found = groups(df.filter(F.col(doc_id).isNotNull()), scratch, words, similarity, text, doc_id)
    kept = scratch.cut(found.filter("doc_id = component_id").select(F.col("doc_id").alias("__id")).distinct())
    order = F.row_number().over(Window.partitionBy("__id").orderBy(F.xxhash64(text), text))
    chosen = df.join(kept, F.col(doc_id) == F.col("__id")).withColumn("__k", order).filter("__k = 1").select(*df.columns)
    return chosen.unionByName(df.filter(F.col(doc_id).isNull()))
