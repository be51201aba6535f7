"""Benchmark decontamination by a prefix-filtered join of item windows with document words.

A window (13 consecutive words of an item, or a shorter item whole) occurs only where its rarest word does. Words are
ordered by their number of occurrences in the documents; a window's prefix is its rarest word alone, since containment must
be whole. Documents are probed with the prefixes, an occurrence must leave room for the window before and after it
(positional and length bound), and is verified word by word.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, lean, slices, stable

# What separates words: every ASCII character but digits and letters; A-Z becomes a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Distinct ``(window: array<binary>, items: array<string>)``; items without a word have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for item, text in zip(batch.column("id").to_pylist(), as_bytes(batch.column("t"))):
                w = words(text)
                for i in range(max(1, len(w) - size + 1) if w else 0):
                    ids.append(item)
                    out.append(b" ".join(w[i : i + size]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.binary())], ["item", "window"])

    cut_up = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null").mapInArrow(cut, "item string, window binary")
    return cut_up.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def word_counts(docs: DataFrame, text_col: str, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often each word of ``vocabulary`` occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in as_bytes(batch.column("t")):
                seen.update(filter(vocabulary.__contains__, words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


def _find(w: list[bytes], prefix: dict[bytes, list[tuple[int, list[bytes], tuple[str, ...]]]]) -> list[tuple[str, int, int]]:
    found = []
    for i in (i for i, x in enumerate(w) if x in prefix) if not prefix.keys().isdisjoint(w) else ():
        for offset, window, items in prefix[w[i]]:
            start = i - offset
            if start >= 0 and start + len(window) <= len(w) and w[start : start + len(window)] == window:
                found += [(item, start, start + len(window)) for item in items]
    return found


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 13, block: int = 100_000) -> DataFrame:
    """Per row of ``docs``: ``(id, n_words, spans: array<struct<start, end>>, items: array<string>)``.

    ``spans`` are the merged word ranges inside windows that occur in the text, ``items`` the sorted distinct ids of the
    items these windows belong to. At most ``block`` windows are sent to the tasks at a time, so what is sent has a
    bound whatever the benchmark's size; a larger benchmark takes several passes, joined exactly by row. Null texts have no words; null
    items are left out; repeated items count once. Rows that repeat an id, or have none, keep their own rows; ``id_col`` may be of any type; other columns
    may have any name; texts are read whole, however long. An empty benchmark gives no hits, an empty ``docs`` no rows.
    """
    cut = stable(windows(benchmark, item_col, item_text_col, size).withColumn("at", F.monotonically_increasing_id()))
    n = cut.count()
    passes = max(1, -(-n // block))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    if passes > 1:
        texts = stable(texts.withColumn("row", F.monotonically_increasing_id()))
    found = None
    for k in range(passes):
        part = cut.where(F.pmod(F.xxhash64("window"), F.lit(passes)) == k).collect()
        split = [(bytes(r["window"]).split(b" "), tuple(r["items"])) for r in part]
        counts = word_counts(texts, "t", frozenset(x for w, _ in split for x in w)) if split else {}
        prefix: dict[bytes, list] = defaultdict(list)
        for w, items in split:
            rarest = min(range(len(w)), key=lambda i: (counts.get(w[i], 0), w[i], i))
            if counts.get(w[rarest], 0):
                prefix[w[rarest]].append((rarest, w, items))
        sent = docs.sparkSession.sparkContext.broadcast(dict(prefix))

        def probe(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "t"):
                sizes, spans, items = [], [], []
                for text in as_bytes(batch.column("t")):
                    w = words(text)
                    hits = _find(w, sent.value)
                    sizes.append(len(w))
                    spans.append([{"start": a, "end": b} for a, b in _merge([x[1:] for x in hits])])
                    items.append(sorted({x[0] for x in hits}))
                keep = [c for c in ("id", "row") if c in batch.schema.names]
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], [*keep, "n_words", "spans", "items"])

        kinds = f"id {texts.schema['id'].dataType.simpleString()}, " + "row long, " * (passes > 1) + "n_words long, spans array<struct<start:bigint,end:bigint>>, items array<string>"
        one = texts.mapInArrow(lean(probe), kinds)
        if passes == 1:
            return one
        found = one if found is None else found.unionByName(one)
    whole = found.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # merge overlapping or touching ranges, kept in order, last range at the end of the accumulated list
    merged = F.expr(
        "aggregate(s, cast(array() as array<struct<start:bigint,end:bigint>>), (acc, x) -> "
        "if(size(acc) > 0 and x.start <= element_at(acc, -1).end, "
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))), "
        "concat(acc, array(x))))"
    )
    return whole.select("id", "n_words", merged.alias("spans"), "items")


def report(docs: DataFrame, benchmark: DataFrame, **more) -> DataFrame:
    """``contamination`` with numbers: ``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``.

    A document is contaminated if a word is hit and hit words are at least a twentieth of its words.
    """
    hit = F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start)")
    return contamination(docs, benchmark, **more).select(
        F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated")
    )


