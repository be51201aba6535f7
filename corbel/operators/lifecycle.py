"""Tables over time: rows erased from the partitions that hold them, and results checked by running their plans again on captured inputs."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonc


def _folder(spark: SparkSession, path: str):
    """The path's file system, and the path as it wants it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def erase(spark: SparkSession, path: str, partition: str, key: str, tombstones: DataFrame, held: DataFrame | None = None, staging: str | None = None) -> dict[str, int]:
    """Removes from a Parquet table, partitioned by one column, the rows whose ``key`` has a tombstone and isn't ``held`` (one column each); says how many rows and partitions it touched.

    Only partitions that hold such a row are written again, by a dynamic overwrite from a staging folder beside the table, and those left empty are deleted; the files of all others stay as they are. What stays is staged whole
    before anything is overwritten, so a lost executor costs a retry and a run that broke off can be made again: a second run finds nothing to do. Null keys have no tombstone.
    """
    table = spark.read.parquet(path)
    dead = tombstones.select(F.col(tombstones.columns[0]).alias("_dead")).where("_dead is not null").distinct()
    if held is not None:
        dead = dead.join(held.select(F.col(held.columns[0]).alias("_dead")), "_dead", "left_anti")
    gone = table.join(dead, F.col(key) == F.col("_dead"), "left_semi").groupBy(partition).agg(F.count("*").alias("_gone"))
    sizes = table.groupBy(F.col(partition).alias("_part")).agg(F.count("*").alias("_all"))
    touched = gone.join(sizes, F.col(partition).eqNullSafe(F.col("_part"))).select(partition, "_gone", "_all").collect()  # a row a partition
    if not touched:
        return {"rows": 0, "partitions": 0}
    names = [r[partition] for r in touched]
    own = F.col(partition).isin(*[n for n in names if n is not None]) if any(n is not None for n in names) else F.lit(False)
    own = own | F.col(partition).isNull() if None in names else own
    stage = staging or f"{path.rstrip('/')}__erasing"
    table.where(own).join(dead, F.col(key) == F.col("_dead"), "left_anti").write.mode("overwrite").parquet(stage)
    kept = spark.read.schema(table.schema).parquet(stage)
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    for r in touched:
        if r["_gone"] == r["_all"]:
            value = "__HIVE_DEFAULT_PARTITION__" if r[partition] is None else str(r[partition])
            escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
            fs, at = _folder(spark, f"{path}/{partition}={escaped}")
            fs.delete(at, True)
    fs, at = _folder(spark, stage)
    fs.delete(at, True)
    return {"rows": sum(r["_gone"] for r in touched), "partitions": len(touched)}


def row_digest(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """A digest of each row: that of its columns as canonical JSON, nulls included."""
    columns = [c for c in df.columns if c not in without]
    return jsonc.digest(jsonc.canonical(F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)), {"ignoreNullFields": "false"})))


def differences(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Each key of either table with ``state``: equal, altered, missing (only before) or added. Keys that repeat are compared by the sorted digests of their rows."""
    digests = lambda df, name: df.select(*key, row_digest(df).alias("d")).groupBy(*key).agg(F.array_sort(F.collect_list("d")).alias(name))
    a, b = digests(before, "before"), digests(after, "after").select(*(F.col(k).alias(f"_{k}") for k in key), "after")
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    state = F.when(F.col("after").isNull(), "missing").when(F.col("before").isNull(), "added").when(F.col("before") == F.col("after"), "equal").otherwise("altered")
    return a.join(b, same, "full").select(*(F.when(F.col("before").isNull(), F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in key), state.alias("state"))


Plan = Callable[[dict[str, DataFrame]], DataFrame]


def capture(spark: SparkSession, folder: str, inputs: dict[str, DataFrame], plan: str, plans: dict[str, Plan]) -> DataFrame:
    """Writes the inputs, runs the plan (named with its version, as ``score@2``) on what was written, and stores its result and a manifest beside them; returns the result.

    Inputs and result are summed up by the digests of their rows, so that what is altered later can be told.
    """
    for name, df in inputs.items():
        df.write.parquet(f"{folder}/inputs/{name}")
    held = {name: spark.read.parquet(f"{folder}/inputs/{name}") for name in inputs}
    plans[plan](held).write.parquet(f"{folder}/result")
    manifest = {"plan": plan, "inputs": {name: table_digest(df) for name, df in held.items()}}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.text(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/result")


def table_digest(df: DataFrame) -> str:
    """One digest of a table whatever the order of its rows: count and sum of 60 bits of each row's digest, with which repeats count."""
    bits = F.conv(F.substring(row_digest(df), 8, 15), 16, 10).cast("decimal(38,0)")
    n, total = df.select(bits.alias("b")).agg(F.count("*"), F.sum("b")).first()
    return f"{n}:{total or 0}"


def replay(spark: SparkSession, folder: str, key: list[str], plans: dict[str, Plan]) -> DataFrame:
    """Runs the captured plan again on the captured inputs, and nothing else, and compares row by row: ``differences`` of the stored result and the new one.

    Inputs that no longer have the digests of their capture, and a plan of a version that isn't at hand, raise ValueError.
    """
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()[0])
    if manifest["plan"] not in plans:
        raise ValueError(f"no plan {manifest['plan']}")
    inputs = {name: spark.read.parquet(f"{folder}/inputs/{name}") for name in manifest["inputs"]}
    if altered := [name for name, df in inputs.items() if table_digest(df) != manifest["inputs"][name]]:
        raise ValueError(f"captured inputs were altered: {altered}")
    return differences(spark.read.parquet(f"{folder}/result"), plans[manifest["plan"]](inputs), key)
