"""Session set-up and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_scratch: list[str] = []


def build_session(app: str = "invoicelake", master: str | None = None, shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the jobs rely on (UTC, adaptive execution)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **(extra or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or a temporary one in local mode only."""
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="invoicelake-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table."""
    path = f"{shared_dir(spark)}/invoicelake/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def staged(df: DataFrame, name: str = "cut", compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage, so a lost executor never restarts the whole chain; the written table is columnar, so later
    steps read only their columns, and its size is known, so the planner can tell small tables from large ones.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """`staged` for narrow tables of hashes, keys and names, which are smaller with zstd."""
    return staged(df, "cut", "zstd")


def drop_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session; call it when no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    for path in _scratch:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _scratch.clear()
