"""Byte-level BPE encoding and decoding of whole texts.

Every match of the split pattern is looked up in two tiers. A minimal perfect hash over the
vocabulary resolves pre-tokens that are one token; what it does not know is merged with a heap
over linked bytes, lowest rank first and leftmost among equals. Results of both tiers are kept in
a memo of bounded size per Python worker, because words repeat.

The vocabulary and the hash travel as one broadcast whose size is that of the vocabulary file.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm.shared import ship

#: Entries of a worker's memo; it starts anew when full.
MEMO_ENTRIES = 400_000
#: Texts longer than this many characters are encoded in runs of pre-tokens instead of one list.
LONG_TEXT = 1_000_000
RUN = 200_000


class PerfectHash:
    """Minimal perfect hash by displacement: n keys, n slots, one displacement per bucket of about four keys.

    Buckets are placed from the largest down by trying displacements; single keys take the slots
    that are left, their slot stored directly as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = self.n // 4 + 1
        rows: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            rows[(h >> 40) % self.buckets].append((h, i))
        self.displacement = [0] * self.buckets
        slots = [-1] * self.n
        for b in sorted(range(self.buckets), key=lambda b: -len(rows[b])):
            row = rows[b]
            if len(row) < 2:
                break
            for d in itertools.count():
                at = [self.place(h, d) for h, _ in row]
                if len(set(at)) == len(at) and all(slots[s] < 0 for s in at):
                    break
            self.displacement[b] = d
            for s, (_, i) in zip(at, row):
                slots[s] = i
        free = (s for s in range(self.n) if slots[s] < 0)
        for b, row in enumerate(rows):
            if len(row) == 1:
                s = next(free)
                slots[s], self.displacement[b] = row[0][1], -s - 1
        self.slots = slots

    def place(self, h: int, d: int) -> int:
        x = ((h & 0xFFFFFFFFFF) + d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x >> 20) % self.n

    def index(self, key: bytes) -> int:
        """The number of the only key that `key` can be."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacement[(h >> 40) % self.buckets]
        return self.slots[-d - 1] if d < 0 else self.slots[self.place(h, d)]


def heap_merge(word: bytes, rank_of) -> list[int]:
    """Ids of a word: merge the adjacent pair of lowest rank until none is in the vocabulary.

    `end[i]` links the token at i to the one after it, `before` the other way; a heap entry
    (rank, start, end) is stale if the two tokens that it spans are no longer neighbours.
    """
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or (j := end[i]) >= n or end[j] != e:
            continue
        alive[j] = False
        end[i] = e
        if e < n:
            before[e] = i
            if (r := rank_of(word[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if (p := before[i]) >= 0 and (r := rank_of(word[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(rank_of(word[i : end[i]]))
        i = end[i]
    return out


class Vocabulary:
    """Ranks of a .tiktoken file with the perfect hash over its tokens."""

    def __init__(self, path: str, pattern: str):
        self.pattern = pattern
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.tokens = [base64.b64decode(t) for t, _ in pairs]
        self.ids = [int(r) for _, r in pairs]
        self.hash = PerfectHash(self.tokens)


class Memo(dict):
    """Pre-token -> its ids as little-endian 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.index, self.tokens, self.ids = vocabulary.hash.index, vocabulary.tokens, vocabulary.ids
        self.rank_of = dict(zip(self.tokens, self.ids)).get

    def __missing__(self, word: str) -> bytes:
        key = word.encode()
        k = self.index(key)
        ids = [self.ids[k]] if self.tokens[k] == key else heap_merge(key, self.rank_of)
        out = np.array(ids, "<u4").tobytes()
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[word] = out
        return out


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.memo = Memo(vocabulary)
        self.split = regex.compile(vocabulary.pattern)
        self.bytes_of = dict(zip(vocabulary.ids, vocabulary.tokens)).__getitem__

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(text) <= LONG_TEXT:
            return b"".join(map(self.memo.__getitem__, self.split.findall(text)))
        found, parts = (m.group() for m in self.split.finditer(text)), []
        while words := list(itertools.islice(found, RUN)):
            parts.append(b"".join(map(self.memo.__getitem__, words)))
        return b"".join(parts)

    def decode(self, ids: bytes | None) -> bytes:
        a, parts = np.frombuffer(ids or b"", "<u4"), []
        for k in range(0, len(a), LONG_TEXT):
            parts.append(b"".join(map(self.bytes_of, a[k : k + LONG_TEXT].tolist())))
        return b"".join(parts)


_CODECS: dict[object, Codec] = {}


def codec(handle) -> Codec:
    """The codec of this worker for a broadcast vocabulary; tasks of one worker share it."""
    if handle.id not in _CODECS:
        _CODECS.clear()
        _CODECS[handle.id] = Codec(handle.value)
    return _CODECS[handle.id]


class Handle:
    """A broadcast with a name that stays the same in all tasks of a query."""

    def __init__(self, broadcast, name: str):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self):
        return self.broadcast.value


@functools.lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def handle(spark, path: str, pattern: str) -> Handle:
    b = spark.sparkContext.broadcast(vocabulary(path, pattern))
    return Handle(b, f"{path}|{pattern}")


#: Rows that a worker turns into one Arrow batch; bounds memory where texts are long.
STEP = 256


def _mapped(df: DataFrame, schema: T.StructType, fields: dict, work) -> DataFrame:
    """`df` with the columns `work(batch slice)` makes; other columns pass through untouched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, STEP):
                part = batch.slice(k, STEP)
                made = work(part)
                arrays = [*part.columns, *(pa.array(v, fields[n]) for n, v in made.items())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names, *made])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add `ids` (little-endian unsigned 32-bit integers as binary) for every whole text.

    `decoded` names a column for the bytes that these ids decode to. Null and empty texts have no
    ids. Repeated rows stay; columns of the same names as the new ones are replaced, all others
    are kept. The vocabulary must hold all single bytes, as byte-level vocabularies do.
    """
    ship(df.sparkSession)
    h = handle(df.sparkSession, path, pattern)
    df = df.drop(ids, *([decoded] if decoded else []))
    fields = {ids: pa.binary()} | ({decoded: pa.binary()} if decoded else {})
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.BinaryType()) for n in fields)])

    def work(part: pa.RecordBatch) -> dict:
        c = codec(h)
        made = [c.encode(x) for x in part.column(part.schema.get_field_index(text)).to_pylist()]
        return {ids: made} | ({decoded: [c.decode(x) for x in made]} if decoded else {})

    return _mapped(df, schema, fields, work)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the bytes that `ids` (binary, as `encode` makes it) stand for; null ids give no bytes."""
    ship(df.sparkSession)
    h = handle(df.sparkSession, path, pattern)
    df = df.drop(decoded)
    schema = T.StructType([*df.schema.fields, T.StructField(decoded, T.BinaryType())])

    def work(part: pa.RecordBatch) -> dict:
        c = codec(h)
        return {decoded: [c.decode(x) for x in part.column(part.schema.get_field_index(ids)).to_pylist()]}

    return _mapped(df, schema, {decoded: pa.binary()}, work)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of an encoded and decoded frame."""
    return df.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
