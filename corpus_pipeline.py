"""A training corpus from the table `documents`: five stages, each on all that the one before kept.

toxicity   documents that the classifier rejects go
lines      lines that a tenth of a source's documents share go
copies     of documents with a five-word similarity of 0.8 or more one stays
repeats    passages of 200 bytes or more that occur again go, in every place
packing    what is left, in sequences of at most 1024 tokens

Every stage but the last returns the columns of documents. A document keeps its row where only
parts of its text go, even if nothing is left of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm import lines, packing, repeats, similar, toxicity
from pagelode.llm.shared import Scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Row order, places of repeated sequences and the classifier are beyond SQL.
ORACLE_SQL = None


def measured(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text now has."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; labels of a held-out fifth are not learnt from."""
    taught = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), taught)
    return toxicity.score(docs.select(*COLUMNS), model).filter("toxic_pred = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go."""
    return measured(lines.dedup(docs.select(*COLUMNS), Scratch(spark), host="source"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    return similar.keep_one(docs.select(*COLUMNS), Scratch(spark))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go. What a cut leaves of a character goes with it."""
    affected = repeats.Repeats(docs, Scratch(spark)).affected.select("key", "kept")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([(x.as_py() or b"").decode("utf-8", "ignore") for x in b.column(1)], pa.string())], names=["key", "rest"])

    rest = affected.mapInArrow(decode, "key binary, rest string")
    out = docs.select(*COLUMNS).withColumn("key", repeats.text_key()).join(rest, "key", "left")
    return measured(out.withColumn("text", F.coalesce("rest", "text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    items = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 2, 1024, added=added)
    return packing.pack(items, 1024, Scratch(spark))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("SimHash near-dedup", drop_copies), ("suffix-array dedup", drop_repeats), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each is written to the shared folder and read again as the next one's input."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
