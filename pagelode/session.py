"""Session settings the jobs rely on."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings that shape plans, independent of cluster size.
#  * windowGroupLimitThreshold: the largest per-page cap is 1200 links, and the
#    row_number() <= cap filter is only pushed below the sort up to this value.
#  * requireAllClusterKeysForCoPartition=false: tables already hashed on page_id
#    join on (page_id, x) without another exchange.
#  * autoBroadcastJoinThreshold=-1: element tables are files of long runs of equal values, a
#    hundredth of the rows they hold, so a size on disk says nothing about what a broadcast takes
#    of the driver. Their joins on page_id need no exchange either way.
#  * bucketedTableScan.outputOrdering, replaceHashWithSortAgg: a staged table has one sorted file
#    a bucket, so joins, windows and groups on page_id read it as it is. A plan that joins fifty
#    tables would otherwise hold fifty sort buffers in every task.
PLAN_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": "2000",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "pagelode", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**PLAN_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the plan settings to a session somebody else created."""
    for key, value in PLAN_CONF.items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: the cluster's checkpoint folder.

    Only where nothing is configured (tests, a laptop) a temporary folder is made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="pagelode-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def local_session(cpus: int | None = None, java_options: str = "") -> SparkSession:
    cpus = cpus or os.cpu_count() or 4
    spark = build_session(
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.extraJavaOptions": f"-Xss8m {java_options}".strip(),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
