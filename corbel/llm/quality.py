"""Quality scores: random Fourier features of document statistics, ridge regression by summed normal equations, isotonic calibration."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, lean, slices, stable
from .textstats import NAMES, stats

D = len(NAMES)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, x: array<float>)``: the statistics of each row's whole text; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            x = [np.nan_to_num(np.array(stats(t), np.float32)) for t in as_bytes(batch.column("t"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(x, pa.list_(pa.float32()))], ["id", "x"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, x array<float>")


@dataclass
class Model:
    """Standardization, frequencies and phases of the features, ridge weights, and the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        out = np.cos(z @ self.freq + self.phase) * np.sqrt(2 / self.freq.shape[1])
        return np.hstack([np.ones((len(x), 1)), out])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, D)


def _summed(rows: DataFrame, of, width: int) -> np.ndarray:
    """Sum over all rows of ``of(x, y)``, an array of ``width`` numbers a batch; a row for each of a bounded number of partitions reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += of(_matrix(batch.column("x")), batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    return np.sum([np.frombuffer(r["s"]) for r in rows.select("x", "y").mapInArrow(run, "s binary").collect()], axis=0)


def pool_adjacent(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Isotonic regression of means ``total / count`` with weights ``count``."""
    blocks: list[list[float]] = []
    for t, c in zip(total, count):
        blocks.append([t, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, c2, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + c2, blocks[-1][2] + k]
    return np.concatenate([np.full(int(k), t / c) for t, c, k in blocks]) if blocks else np.zeros(0)


def fit(labelled: DataFrame, features: int = 256, gamma: float = 0.03, ridge: float = 1e-3, most: int = 40_000, parts: int = 8, seed: int = 11) -> Model | None:
    """A model from ``labelled(id, x, y)``, y being 0 or 1; None if there are no rows.

    At most about ``most`` rows are used, drawn by a hash of the id. Two thirds fit the ridge weights, a third calibrates them;
    rows meet in ``parts`` partitions, so the sums that reach the driver have a fixed size.
    """
    n = labelled.count()
    if not n:
        return None
    rows = stable(labelled.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, most / n) * (1 << 30))).repartition(parts, F.xxhash64("id")))
    m = _summed(rows, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * D)
    if not m[0]:
        return None
    mean = m[1 : 1 + D] / m[0]
    scale = np.sqrt(np.maximum(m[1 + D :] / m[0] - mean**2, 1e-6))
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(0, np.sqrt(2 * gamma), (D, features)), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(1), np.zeros(1))
    k = features + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    third = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(3))
    fold = rows.where(third != 0) if m[0] >= 30 else rows
    sums = _summed(fold, normal, k * k + k)
    model.weights = np.linalg.solve(sums[: k * k].reshape(k, k) + ridge * m[0] / k * np.eye(k), sums[k * k :])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.clip(np.round(model.raw(_matrix(batch.column("x"))) * 200), -400, 600).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("y").cast(pa.float64())], ["cell", "y"])

    held = rows.where(third == 0) if m[0] >= 30 else rows
    cells = held.select("x", "y").mapInArrow(raw, "cell long, y double").groupBy("cell").agg(F.sum("y").alias("t"), F.count("*").alias("c")).orderBy("cell").collect()  # at most 1,001 rows
    if cells:
        model.knots = np.array([r["cell"] / 200 for r in cells])
        model.values = pool_adjacent(np.array([r["t"] for r in cells]), np.array([float(r["c"]) for r in cells]))
    return model


def scored(rows: DataFrame, model: Model | None) -> DataFrame:
    """``rows(id, x)`` with ``score`` in 0..1, higher for label 1; without a model 0.5."""
    sent = rows.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        for batch in batches:
            x = _matrix(batch.column("x"))
            s = own.score(x) if own is not None and len(x) else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s)], ["id", "score"])

    return rows.select("id", "x").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def quality(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", key_col: str | None = None, **more) -> DataFrame:
    """``(id, score)`` for every row of ``docs``, learned from the rows of ``labels`` with a label of 0 or 1.

    ``train`` is a predicate of an id column. Labels of ids without a document, null labels and labels that contradict another
    label of the same id are left out; of several texts under one id one is learned from. Texts, never their ids or other columns, make the score, so equal
    texts tie; whole texts are read however long they are, and empty and null ones have a score too. Null ids are scored and not learned from. Other
    columns may have any name. An empty table gives an empty table; without labels all scores are 0.5. With ``key_col``, a string column that
    is the same for rows of the same text only, the result's ``id`` is that key.
    """
    key = key_col or id_col
    x = stable(statistics(docs, key, text_col))
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("top")).where("y = top")
    if key_col:  # labels to texts; the one with the smallest key of an id, and of a text's labels the mean would be neither: contradictions are left out
        of_id = docs.select(F.col(id_col).alias("doc"), F.col(key_col).alias("id")).where(train(F.col("doc"))).groupBy("doc").agg(F.min("id").alias("id"))
        known = of_id.join(known, "doc").groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top")
    else:
        known = known.where(train(F.col("doc"))).withColumnRenamed("doc", "id")
    learn = x.join(known.select("id", "y"), "id").groupBy("id").agg(F.min(F.struct("x", "y")).alias("r")).select("id", "r.*")
    return scored(x, fit(stable(learn), **more))
