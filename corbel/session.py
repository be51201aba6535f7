"""Sessions, and the only way to open a tenant's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    build = SparkSession.builder.master(f"local[{cores}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", memory)
    for k, v in (SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)}).items():
        build = build.config(k, v)
    return build.getOrCreate()


def workspace_scope(df: DataFrame, workspace: object, column: str = "workspace_id") -> DataFrame:
    """Rows of one workspace; without a workspace none, as an unscoped read sees nothing. The filter reaches the scan."""
    return df.where(F.lit(False)) if workspace is None else df.where(F.col(column) == F.lit(workspace))


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, times without a zone read as UTC. Texts go to Python in batches of 4 MB at most, unless the session's own settings name a size."""
    if not spark.sparkContext.getConf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, "4m")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}) if "timestamp_ntz" in dict(df.dtypes).values() else df


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """``df`` dealt evenly over tasks, four for each core unless told: small files bring few tasks, however much is to be done for a row."""
    return df.repartition(tasks or _tasks(df.sparkSession))


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by the hash of columns, over as many tasks as ``spread`` has: without the sort that an even deal needs to be repeatable."""
    return df.repartition(_tasks(df.sparkSession), *by)


def _tasks(spark: SparkSession) -> int:
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def optional_predicate(column: Column, value: object, make) -> Column:
    """``make(column, value)``, or true where no value is given."""
    return F.lit(True) if value is None else make(column, F.lit(value))
