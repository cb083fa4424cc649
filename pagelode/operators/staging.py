"""When a table is kept: written once to the shared folder, bucketed by page."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from pagelode.session import shared_dir


class table(cached_property):  # noqa: N801
    """A lazily built table of its owner, staged on first use when the owner keeps its tables."""

    def __get__(self, owner, cls=None):
        if owner is None:
            return self
        if self.attrname not in owner.__dict__:
            df = self.func(owner)
            if getattr(owner, "kept", False):
                df = stage(df, self.attrname, getattr(owner, "buckets", None))
            owner.__dict__[self.attrname] = df
        return owner.__dict__[self.attrname]


def stage(df: DataFrame, name: str, buckets: int | None = None) -> DataFrame:
    """Write a table and read it back: lineage ends there, and scans prune columns.

    The rows are already hashed by `page_id`, so every task writes its own buckets without a
    shuffle, and later joins and windows on `page_id` need none either. A lost executor
    re-reads files instead of recomputing the page. A bucketed scan is one task a bucket, so
    `buckets` should grow with the input: bytes of markup divided by what a task can hold.
    """
    spark = df.sparkSession
    ident = f"stage_{name}_{uuid.uuid4().hex[:12]}"
    path = f"{shared_dir(spark)}/{ident}"
    writer = df.write.option("path", path)
    if "page_id" in df.columns:
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        writer = writer.bucketBy(n, "page_id").sortBy(*(["page_id"] + (["seq"] if "seq" in df.columns else [])))
    writer.saveAsTable(ident)
    _STAGED.append((ident, path))
    return spark.table(ident)


def held(owner, df: DataFrame, name: str) -> DataFrame:
    """A table that is no attribute of its owner, staged if the owner keeps its tables.

    For what is read more than once, and for parts of a wide join: a task then holds the buffers of one part at a time.
    """
    return stage(df, name, getattr(owner, "buckets", None)) if getattr(owner, "kept", False) else df


_STAGED: list[tuple[str, str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Drop every table staged inside, with its files, at the end."""
    before = len(_STAGED)
    try:
        yield
    finally:
        for ident, path in _STAGED[before:]:
            spark.sql(f"DROP TABLE IF EXISTS {ident}")
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        del _STAGED[before:]
