"""Connected components of an edge table by alternating star contractions; nothing is gathered on the driver but two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clearing, stable


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of longs to ``(node, component)``, the component being its smallest node.

    Self-links and nulls are ignored; nodes without a link to another node do not appear. An empty table gives an
    empty table. Each round halves the distance to the smallest node; a round's table is written to the shared folder and deleted at the end.
    """
    with clearing(edges.sparkSession) as keep:
        now = stable(edges.select("u", "v").where("u <> v").distinct())
        before = _state(now)
        for _ in range(rounds if before[0] else 0):
            now = stable(_small_star(_large_star(now)))
            after = _state(now)
            if after == before:
                break
            before = after
        else:
            if before[0]:
                raise RuntimeError(f"components did not settle in {rounds} rounds")
        lows = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return keep(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(lows))
