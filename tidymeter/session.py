"""Session helpers: local test session, shared scratch folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows of a task that works hard on each of them.
SPREAD_ROWS = 50_000


def local_session(cores: int | str = "*", app: str = "tidymeter", **conf) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    ``spark.checkpoint.dir`` names it. Only a local master may fall back to a
    folder of its own: on a cluster the executors could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.tidymeter.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="tidymeter-")
        spark.conf.set("spark.tidymeter.scratch", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def _own_folder(spark: SparkSession) -> str:
    return os.path.join(scratch_root(spark), f"tidymeter-{spark.sparkContext.applicationId}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's scratch folder; nothing is ever overwritten."""
    return os.path.join(_own_folder(spark), f"{name}-{uuid.uuid4().hex}")


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once its results are written."""
    _delete(spark, _own_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that a lost executor never replays the lineage."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


# A row of several MB is written as a row group of its own. Sizes are looked at after every row, not first after 100.
LARGE_ROWS = {"parquet.block.size": 1 << 20, "parquet.enable.dictionary": "false"} | {
    f"parquet.{part}.size.row.check.{end}": 1 for part in ("block", "page") for end in ("min", "max")
}


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write to the shared scratch folder and read back: columnar, and safe against lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)  # a known schema saves a job that looks into the files
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later step reads; what was derived from them must be written already."""
    for df in tables:
        _delete(df.sparkSession, df.scratch)


def spread_rows(df: DataFrame) -> DataFrame:
    """Spread a table over tasks of about ``SPREAD_ROWS`` rows, one per core at least.

    For stages that work hard on every row. The rows of the splits are counted, since a
    file is never cut inside a row group: of many splits most may be empty. The count
    reads no column of a table; filters belong behind the spreading.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("rows"))
    found = splits.agg(F.count(F.lit(1)).alias("splits"), F.max("rows").alias("most"), F.sum("rows").alias("rows")).first()
    rows = found["rows"] or 0
    if found["splits"] >= cores and found["most"] <= 2 * SPREAD_ROWS:
        return df
    return df.repartition(max(cores, -(-rows // SPREAD_ROWS)))
