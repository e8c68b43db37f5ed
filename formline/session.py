"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "formline", cpus: str = "8") -> SparkSession:
    """A session for tests and for bench.py; on a cluster the submitter owns these settings."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Base folder every executor can reach: ``spark.checkpoint.dir`` where the cluster names it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.gettempdir()


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for one run, so no run ever overwrites another's files."""
    return f"{shared_dir(spark).rstrip('/')}/formline-{label}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as parquet and go on from the files: later readers of the result do not repeat its
    plan, and a lost executor costs a re-read. ``path`` must be reachable by all executors."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def setting(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(f"spark.formline.{name}", str(default)))


def leaf_bytes(df: DataFrame) -> int:
    """Total size of the files and relations below ``df``, from the analyzed plan: no job, no planning."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        size = leaves.apply(i).stats().sizeInBytes()
        total += int(str(size))
    return total
