"""Vector code compression: a product quantizer in integers.

Components become integers, vectors are cut into parts, and each part position has a codebook. The codebooks are small (parts times entries) and go to all
tasks; Arrow batches compute all squared distances as |v|^2 - 2 v.c + |c|^2 with exact int64 matrix products and take the first smallest. Each
task adds up what falls to an entry, the sums are merged by a grouped shuffle, and the driver gets one row an entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stable

SCALE = 4096
MOST = 1 << 28  # components as integers; squared distances over a part stay inside int64

Codebooks = list[list[list[int]]]  # by part, entry, place


def integers(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, v)``, v being floor(scale x), of the rows whose vector is not null and has finite components only; a vector without components has none and is dropped too."""
    rows = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(F.col("x").isNotNull() & (F.size("x") > 0)).where(finite).select("vec_id", "label", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), -1)


def _nearest(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of vectors (n, parts, width) under codebooks (parts, entries, width): the first nearest entry of each part, and its squared distance."""
    codes, errors = np.empty(v.shape[:2], np.int64), np.empty(v.shape[:2], np.int64)
    for p in range(v.shape[1]):
        part, book = v[:, p], books[p]
        far = (book * book).sum(1)[None, :] - 2 * (part @ book.T)
        codes[:, p] = far.argmin(1)
        errors[:, p] = far.min(1) + (part * part).sum(1)
    return codes, errors


def start(vectors: DataFrame, parts: int, entries: int) -> Codebooks:
    """Each part of the vectors of the ``entries`` smallest ids: a top-k in Spark, at most so many rows here. Null ids come last, equal ids go by their vectors; fewer vectors give fewer entries."""
    first = [r["v"] for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    width = len(first[0]) // parts if first else 0
    return [[list(v[p * width : (p + 1) * width]) for v in first] for p in range(parts)]


def refine(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: each entry becomes the floored mean of the parts that are nearest to it; an entry without parts stays."""
    sent, parts, entries, width = np.array(books, np.int64), len(books), len(books[0]), len(books[0][0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v")).reshape(-1, parts, width)
                codes, _ = _nearest(v, sent)
                for p in range(parts):
                    count[p] += np.bincount(codes[:, p], minlength=entries)
                    np.add.at(total[p], codes[:, p], v[:, p])
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(count[p, e], pa.int64()), "total": pa.array(total[p, e].tolist(), pa.list_(pa.int64()))})

    each = vectors.select("v").mapInArrow(lean(sums), "part int, entry int, n long, total array<long>")
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))  # noqa: E731  over all tasks sums may pass 64 bits
    merged = each.groupBy("part", "entry").agg(wide(F.col("n")).alias("n"), F.array(*(wide(F.get("total", k)) for k in range(width))).alias("total"))
    new = [[list(c) for c in book] for book in books]
    for r in merged.collect():  # a row an entry
        new[r["part"]][r["entry"]] = [int(t) // int(r["n"]) for t in r["total"]]
    return new


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``(vec_id, label, code, error)``: two hex digits a part, and the squared distances added up."""
    sent, parts = np.array(books, np.int64), len(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, errors = _nearest(_matrix(batch.column("v")).reshape(batch.num_rows, parts, -1), sent)
                text = [row.tobytes().hex() for row in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(errors.sum(1), pa.int64())], ["vec_id", "label", "code", "error"])

    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}
    return vectors.mapInArrow(lean(coded), f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long")


def decoded(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``codes`` with ``vector``, the integers that a code stands for: its parts' entries one after the other."""
    table = F.array(*(F.array(*(F.array(*(F.lit(x).cast("long") for x in entry)) for entry in book)) for book in books))
    entry = lambda p: F.conv(F.substring(F.col("code"), 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.flatten(F.array(*(F.get(F.get(table, p), entry(p)) for p in range(len(books))))))


def digest(books: Codebooks) -> str:
    """sha256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def fit(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks:
    """Codebooks over all of stable ``vectors(vec_id, v)``. Lengths must be one multiple of ``parts``, and integers within 2^28 either way, so that distances are exact; else ValueError."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part")
    size, top = F.size("v"), F.greatest(F.array_max("v"), -F.array_min("v"))
    low, high, most = vectors.agg(F.min(size), F.max(size), F.max(top)).first()
    if low is None:
        return [[] for _ in range(parts)]
    if low != high or low % parts or most > MOST:
        raise ValueError(f"vectors have {low} to {high} components of up to {most}; {parts} equal parts and at most {MOST} are needed")
    books = start(vectors, parts, entries)
    for _ in range(rounds):
        books = refine(vectors, books)
    return books


def compress(rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)``, a row for each vector that is kept.

    Dropped: null vectors, vectors with a null, NaN or infinite component or without components. Null ids and labels stay: null labels are one group, null ids come last where codebooks start. Rows that repeat
    an id or are repeated whole each have their row. Equal distances go to the lower index. An empty table gives an empty one. Other columns may have any name.
    Vectors of unlike lengths, or too large for exact distances, raise ValueError. Each round reads the integers again, written once to the shared folder, and shuffles a row for each task and entry.
    """
    vectors = stable(integers(rows, id_col, vector_col, label_col, scale))
    books = fit(vectors, parts, entries, rounds)
    if not books[0]:
        return vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))
    coded = stable(encode(vectors, books))
    by_label = stable(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    few = F.broadcast(by_label) if by_label.count() <= 100_000 else by_label
    return coded.join(few, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
