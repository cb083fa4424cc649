"""What the operators of this subpackage have in common: table access, shared intermediate tables, shipping."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where neither PYTHONPATH nor the working folder has it."""
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT in map(os.path.abspath, filter(None, paths)) or os.path.isdir(os.path.join(os.getcwd(), "pagelode", "llm")):
        return
    sc = spark.sparkContext
    if not any(p.endswith("pagelode_src.zip") for p in sc._python_includes):
        folder = tempfile.mkdtemp()  # on the driver only; Spark hands the archive to every worker
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "pagelode_src"), "zip", ROOT, "pagelode"))


class Scratch:
    """Tables written to the shared checkpoint folder, so that lost executors cost no recomputation.

    The folder is the one the session names (spark.checkpoint.dir); only where none is set, as in
    local tests, is one made. `cut` writes a frame once and reads it back: later jobs start from
    the files. `drop` deletes what is no longer read.
    """

    def __init__(self, spark: SparkSession):
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        self.spark = spark
        self.folder = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
        self.n = 0
        ship(spark)

    def cut(self, df: DataFrame) -> DataFrame:
        """Write `df` and read it back."""
        path = f"{self.folder}/{self.n}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(path)
        self.tidy()
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def tidy(self) -> None:
        """Let Spark delete shuffle files of jobs that are over: it does so when the driver collects garbage."""
        self.spark._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        """Delete the files behind frames that `cut` returned."""
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def key_of(df: DataFrame, *cols: str):
    """Two 64-bit hashes of the given columns as one string key for rows without a safe unique id."""
    return F.concat(F.hex(F.xxhash64(*cols)), F.hex(F.xxhash64(F.lit(7), *cols)))


def partitions_for(rows: int, per_partition: int, spark: SparkSession) -> int:
    """As many partitions as keep `per_partition` rows in each, at least the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))
