"""Streams: screening of arriving texts into append-only tables, keyed rate limits, once-only deliveries, windowed counts."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import detect
from ..operators.detect import Rule
from . import keyed


def read_table_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def screen(stream: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str, out: str, checkpoint: str) -> StreamingQuery:
    """Findings and verdicts of each arriving batch, written once under the batch's number: a batch that is run again writes over itself."""

    def batch(df: DataFrame, n: int) -> None:
        df = df.persist()
        detect.findings(df, rules, id_col, text_col).write.mode("overwrite").parquet(f"{out}/findings/batch={n}")
        detect.decide(df, rules, id_col, text_col).write.mode("overwrite").parquet(f"{out}/verdicts/batch={n}")
        df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RuleSource:
    """Rules from a table that may change between batches ``(id, phrase, reason, severity, disposition, version, tenants, sources)``.

    Each batch reads the table again; a set that is invalid, empty or can't be read leaves the last good one in force, and ``error`` says why. A rule set is
    configuration of at most ``detect.MOST_RULES`` rows, so it is read whole.
    """

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = ()):
        self.spark, self.path, self.rules, self.error = spark, path, rules, None

    def current(self) -> tuple[Rule, ...]:
        try:
            rows = self.spark.read.parquet(self.path).limit(detect.MOST_RULES + 1).collect()
            many = lambda x: None if x is None else tuple(x)
            rules = tuple(Rule(r["id"], r["phrase"], r["reason"], r["severity"], r["disposition"], r["version"], many(r["tenants"]), many(r["sources"])) for r in sorted(rows, key=lambda r: r["id"] or ""))
            bad = detect.violations(rules)
            if bad or not rules:
                raise ValueError(f"invalid rules: {bad}" if bad else "no rules")
            self.rules, self.error = rules, None
        except Exception as e:  # whatever is wrong with the table, screening goes on
            self.error = str(e)
        if not self.rules:
            raise RuntimeError(f"no rules have ever been valid: {self.error}")
        return self.rules


def screen_reloading(stream: DataFrame, source: RuleSource, id_col: str, text_col: str, out: str, checkpoint: str) -> StreamingQuery:
    """``screen`` under the rules that are in force when a batch begins; verdicts name the rules' digest."""

    def batch(df: DataFrame, n: int) -> None:
        rules = source.current()
        digest = hashlib.sha256(repr(rules).encode()).hexdigest()
        decided = detect.decide(df, rules, id_col, text_col).withColumn("rules_digest", F.lit(f"sha256:{digest}"))
        decided.write.mode("overwrite").parquet(f"{out}/verdicts/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_only(stream: DataFrame, key: list[str], time_col: str, within: str) -> DataFrame:
    """The first row of a key within a time span, whatever repeats."""
    return stream.withWatermark(time_col, within).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, time_col: str, labels: list[str], window: str, late: str) -> DataFrame:
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), *labels).agg(F.count("*").alias("n"))


def rate_limited(stream: DataFrame, key: str, at_ms: str, order: str, window_ms: int, most: int, late: str = "0 seconds") -> DataFrame:
    """Each request of a key with its window's start, its number in it, and whether it is allowed; ``keyed.streamed`` with ``keyed.Windows``, so a window is forgotten when its time is over."""
    return keyed.streamed(stream, keyed.Windows(window_ms, most), key, at_ms, order, late).select(key, order, "window_start", "hit", "allowed")
