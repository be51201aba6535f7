"""Readers: JSON sample corpora, uploaded files, office archives, filings, announcements; writers: append, NDJSON, content-addressed."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

SAMPLES = "schema_version string, samples array<struct<id:string,partition:string,language:string,content:string,spans:array<struct<text:string,category:string>>,intent:string,severity:string,expected_disposition:string>>"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """One row a sample of JSON corpus files; the schema is given, never inferred."""
    return spark.read.schema(SAMPLES).json(path, multiLine=True).select(F.inline("samples"))


# First bytes of accepted uploads: fixed values.
MAGIC = {"application/pdf": "%PDF-", "application/zip": "PK\x03\x04", "image/png": "\x89PNG"}
TEST_VIRUS = "X5O!P%@AP[4\\PZX54(P^)7CC)7}$EICAR"


def read_uploads(spark: SparkSession, path: str, most: int = 100 << 20) -> DataFrame:
    """Files with digest, detected type and ``state``: quarantined, or rejected for size, unknown type, or the scanner test string in the first 4,096 bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path"), *inspect_upload(F.col("content"), F.col("length"), most))


def inspect_upload(content: Column, length: Column, most: int = 100 << 20) -> list[Column]:
    kind = F.lit(None).cast("string")
    for name, first in MAGIC.items():
        raw = first.encode("latin-1")
        kind = F.when(F.substring(content, 1, len(raw)) == F.lit(raw), name).otherwise(kind)
    kind = F.coalesce(kind, F.when(F.is_valid_utf8(F.substring(content, 1, 4096).cast("string")), "text/plain"))
    virus = F.instr(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), TEST_VIRUS) > 0
    state = F.when(length > most, "size_limit").when(kind.isNull(), "type_rejected").when(virus, "malware").otherwise("quarantined")
    return [F.concat(F.lit("sha256:"), F.sha2(content, 256)).alias("digest"), kind.alias("media_type"), length.alias("size"), state.alias("state")]


_PARTS = {"docx": r"word/(document|header\d+|footer\d+)\.xml", "xlsx": r"xl/(sharedStrings|worksheets/sheet\d+)\.xml", "pptx": r"ppt/slides/slide\d+\.xml"}
OFFICE = "path string, part string, start int, end int, text string, complete boolean, problem string"


def office_parts(content: bytes, kind: str, most_entries: int = 2_000, most_bytes: int = 50 << 20) -> list[tuple]:
    """``(part, start, end, text)`` of an archive's text parts by name, offsets running on with one blank between."""
    out, at = [], 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.infolist()
        if len(names) > most_entries or sum(i.file_size for i in names) > most_bytes:
            raise ValueError("DOCUMENT_LIMIT")
        for name in sorted(i.filename for i in names if re.fullmatch(_PARTS[kind], i.filename)):
            text = re.sub(r"\s+", " ", " ".join(ET.fromstring(z.read(name)).itertext())).strip()
            if text:
                out.append((name, at, at + len(text), text))
                at += len(text) + 1
    return out


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """Text parts of docx, xlsx and pptx files; a broken file gives one row with its problem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,xlsx,pptx}").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(name, *p, True, None) for p in office_parts(bytes(content), name.rsplit(".", 1)[1].lower())]
                except Exception as e:  # a file of an untrusted source must not end the job
                    rows.append((name, None, None, None, None, False, str(e)[:200] or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "part", "start", "end", "text", "complete", "problem"])

    return files.mapInPandas(run, OFFICE)


def filings(df: DataFrame, text_col: str) -> DataFrame:
    """Fields of regulatory filing texts: form type, date, number of documents, whether it amends another."""
    t = F.col(text_col)
    form = F.trim(F.regexp_extract(t, "(?m)^<TYPE>([^\\n<]+)", 1))
    return df.select("*", form.alias("form"), F.regexp_extract(t, "<FILING-DATE>(\\d{4}-?\\d{2}-?\\d{2})", 1).alias("filed"), F.regexp_count(t, F.lit("<DOCUMENT>")).alias("n_documents"), form.rlike("/A$").alias("amends"))


def filing_documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, k, anchor, start, end, type, filename, description)``: a row for each ``<DOCUMENT>`` of a filing, from its tag to the next one or the text's end, its end tag included if there is one.

    Offsets are zero-based code points of the whole text; fields are those of the document's own part, null where it has none. A filing without documents, and a null text, have no row.
    """
    tag, end = "<DOCUMENT>", "</DOCUMENT>"
    rows = df.select(id_col, F.col(text_col).alias("_text"), T.occurrences(F.col(text_col), F.lit(tag)).alias("_starts"))
    rows = rows.select(id_col, "_text", "_starts", F.posexplode("_starts").alias("k", "start"))
    upto = F.coalesce(F.get("_starts", F.col("k") + 1), F.char_length("_text"))
    rows = rows.select(id_col, "k", "start", F.substring(F.col("_text"), F.col("start") + 1, upto - F.col("start")).alias("_part"))
    closed = F.position(F.lit(end), F.col("_part"))
    rows = rows.withColumn("_part", F.when(closed > 0, F.left("_part", closed + len(end) - 1)).otherwise(F.col("_part")))
    field = lambda name: F.nullif(F.trim(F.regexp_extract("_part", f"<{name}>([^\\r\\n<]+)", 1)), F.lit(""))
    return rows.select(id_col, "k", F.concat(F.lit("document:"), (F.col("k") + 1).cast("string")).alias("anchor"), "start", (F.col("start") + F.char_length("_part")).alias("end"), field("TYPE").alias("type"), field("FILENAME").alias("filename"), field("DESCRIPTION").alias("description"))


ANNOUNCEMENTS = "array<struct<symbol:string,title:string,published_at:string>>"


def announcement(df: DataFrame, json_col: str, symbol: Column) -> DataFrame:
    """The first announcement of a symbol in a JSON list; ``unavailable`` if the text is no such list or has none."""
    rows = F.from_json(F.col(json_col), ANNOUNCEMENTS, {"mode": "PERMISSIVE"})
    first = F.get(F.filter(rows, lambda x: F.upper(x["symbol"]) == F.upper(symbol)), 0)
    return df.withColumn("announcement", first).withColumn("state", F.when(F.col("announcement").isNull(), "unavailable").otherwise("current"))


def collect_feed(items: DataFrame, known: DataFrame, domains: list[str]) -> DataFrame:
    """Feed items ``(adapter_id, pos, url, content_digest)`` as current or duplicate of a known or earlier digest; one foreign host fails its adapter's batch."""
    from ..functions.text import host

    ok = items.groupBy("adapter_id").agg(F.bool_and(host(F.col("url")).isin(*domains)).alias("ok"))
    first = items.groupBy("adapter_id", "content_digest").agg(F.min("pos").alias("first"))
    seen = known.select("content_digest").distinct().withColumn("known", F.lit(True))
    rows = items.join(ok, "adapter_id").join(first, ["adapter_id", "content_digest"]).join(seen, "content_digest", "left")
    state = F.when(~F.col("ok"), "rejected").when(F.coalesce("known", F.lit(False)) | (F.col("pos") > F.col("first")), "duplicate").otherwise("current")
    return rows.select(*items.columns, state.alias("state"))


def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(partition) if partition else w).parquet(path)


def append_ndjson(df: DataFrame, path: str) -> None:
    """Audit lines; null fields are left out."""
    df.write.mode("append").option("ignoreNullFields", "true").json(path)


def write_content_addressed(df: DataFrame, path: str, digest: str, content: str) -> DataFrame:
    """Appends rows whose digest is not stored yet, and returns rows whose digest does not fit their content."""
    good = F.concat(F.lit("sha256:"), F.sha2(F.col(content).cast("binary"), 256)) == F.col(digest)
    spark = df.sparkSession
    new = df.where(good).dropDuplicates([digest])
    try:
        new = new.join(spark.read.schema(df.schema).parquet(path).select(digest), digest, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.select(df.columns).write.mode("append").parquet(path)
    return df.where(~good)
