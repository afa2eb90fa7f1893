"""Session helpers for tests, bench and queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "16g", name: str = "candlework") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def joining_dealt(spark: SparkSession) -> SparkSession:
    """A session with the same settings, but whose joins take rows dealt by some of the join's keys as they are.

    Else both sides are shuffled by all keys. Where few keys hold many rows that is wanted, so the given session is left alone.
    """
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return own


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder the cluster names in spark.checkpoint.dir.

    Only where that setting is absent, as in tests, a local temporary folder is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="candlework-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For input that is scanned many times, such as by a loop of fits: the lineage ends here, and
    a lost executor costs a re-read and not a recomputation.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def size_shuffles(spark: SparkSession, shuffled_bytes: int, per_partition: int = 200 << 20) -> int:
    """Raise spark.sql.shuffle.partitions so that partitions stay near 200 MB.

    Adaptive execution merges small partitions but does not split those a window reads.
    """
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shuffled_bytes // per_partition))
    spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return wanted
