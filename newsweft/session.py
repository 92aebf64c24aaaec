"""Session defaults and durable checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "newsweft", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    Adaptive execution picks the join strategy from measured sizes, splits skewed
    join partitions and merges small ones, so ``spark.sql.shuffle.partitions`` is
    an upper bound to be raised with the cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # A text table costs much work for its bytes: small splits, and as many as there are cores at least.
        "spark.sql.files.maxPartitionBytes": "32m",
        "spark.sql.files.openCostInBytes": "64k",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints and stored tables.

    The cluster names it in ``spark.checkpoint.dir``. Where it is unset, a folder of this run below the
    warehouse is used, which all executors have to share as well.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/newsweft-checkpoints-{uuid.uuid4().hex}"
    sc.setCheckpointDir(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Write a DataFrame below the checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` and survives lost executors the same way; read
    back from files, the table also brings its true size into the next plan.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/newsweft-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_all_cores(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many tasks as the session shuffles to, however few bytes they are.

    Adaptive execution merges tasks by their bytes; rows that cost much more work than their bytes tell would then wait for one core.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
