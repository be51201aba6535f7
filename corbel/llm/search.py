"""Exact BM25 top-k search: an inverted index in shards, block-max pruning in each, and a merge under global statistics.

A shard holds about ``shard_bytes`` of texts as postings, sorted by term hash (XXH3, 64 bits). Documents stand in blocks of four, and each term that
many documents have keeps its largest contribution in each block. What a block can add at most is the sum of its terms' largest contributions, for many queries at a time one product
of matrices; a document's bound is that plus what its rarer terms add exactly. As in WAND, the next pivot is the document with the highest bound, and the search ends
at the first pivot whose bound is below the k-th score so far, which a task carries on from shard to shard; documents before it are scored in full. Scores
are rounded to six decimals before they are ranked, so that equal texts tie wherever they are; sums within a shard differ by far less. Document
frequencies, document count and mean length are those of all shards, so the tasks' results merge exactly.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, lean, stable
from .decontaminate import words

BLOCK = 4
TOGETHER = 128  # queries whose bounds are made in one product
DIGITS = 6
INDEX = "ids array<long>, lengths array<long>, terms array<long>, offsets array<long>, docs array<int>, tfs array<int>"


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def build(docs: DataFrame, id_col: str, text_col: str, shard_bytes: int) -> DataFrame:
    """One row a shard: documents' ids and lengths, and the postings of each term, documents by their number in the shard. Rows of one id, or of none, go to shards by their texts."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = int(size // shard_bytes) + 1

    def index(part: pa.Table) -> pa.Table:
        number, ids, lengths, terms, tfs = _Numbers(), [], [], [], []
        for batch in part.to_batches(max_chunksize=1024):
            for doc, text in zip(batch.column("id").to_pylist(), as_bytes(batch.column("t"))):
                w = words(text)
                ids.append(doc)
                lengths.append(len(w))
                term, tf = np.unique(np.fromiter(map(number.__getitem__, w), np.int32, len(w)), return_counts=True)
                terms.append(term)
                tfs.append(tf.astype(np.int32))
        n = np.array(lengths, np.int64)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in terms])
        term, tf = np.concatenate([*terms, np.zeros(0, np.int32)]), np.concatenate([*tfs, np.zeros(0, np.int32)])
        by_term = np.argsort(term, kind="stable")
        doc, tf = doc[by_term], tf[by_term]
        hashes = np.fromiter(map(_hash, number), np.int64, len(number))
        order = np.argsort(hashes)
        counts = np.bincount(term, minlength=len(hashes))
        starts = np.cumsum(counts) - counts
        take = np.repeat(starts[order], counts[order]) + _within(counts[order])
        cells = [ids, n, hashes[order], np.concatenate([[0], np.cumsum(counts[order])]), doc[take], tf[take]]
        kinds = [pa.int64()] * 4 + [pa.int32()] * 2
        return pa.table({k: pa.array([c], pa.list_(t)) for k, c, t in zip(("ids", "lengths", "terms", "offsets", "docs", "tfs"), cells, kinds)})

    return rows.groupBy(F.pmod(F.xxhash64("id", "t"), F.lit(shards)).alias("shard")).applyInArrow(index, INDEX)


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count in turn."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Shard:
    """An index row with the weights of its postings, and the frequent terms over blocks."""

    def __init__(self, row: dict[str, np.ndarray], mean: float, k1: float, b: float):
        lengths, self.terms, self.offsets, self.docs, tfs = (row[c] for c in ("lengths", "terms", "offsets", "docs", "tfs"))
        self.n, self.scored = len(lengths), 0
        self.weights = tfs * (k1 + 1) / (tfs + k1 * (1 - b + b * lengths[self.docs] / max(mean, 1e-9)))
        df = np.diff(self.offsets)
        often = np.flatnonzero(df >= max(32, self.n // 16))
        self.dense_row = np.full(len(df), -1)
        self.dense_row[often] = np.arange(len(often))
        self.blocks = -(-self.n // BLOCK)
        self.dense = np.zeros((len(often), self.blocks * BLOCK))
        for i, t in enumerate(often):
            at = slice(self.offsets[t], self.offsets[t + 1])
            self.dense[i, self.docs[at]] = self.weights[at]
        self.block_max = self.dense.reshape(len(often), self.blocks, BLOCK).max(2).astype(np.float32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the terms in this shard, -1 for none."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query's (hashes, idf) the numbers and scores of the documents that may be in its top k, ``least`` being the k-th score it has already."""
        for begin in range(0, len(queries), TOGETHER):
            some = [(self.find(t), w) for t, w in queries[begin : begin + TOGETHER]]
            asked = np.zeros((len(some), len(self.block_max)), np.float32)
            for i, (t, w) in enumerate(some):
                known = t >= 0
                row = self.dense_row[t[known]]
                asked[i, row[row >= 0]] = w[known][row >= 0]
            bounds = asked @ self.block_max * np.float32(1 + 1e-4)  # rounding of 32 bits is far below that
            for i, (t, w) in enumerate(some):
                yield self.top(t, w, k, bounds[i], float(least[begin + i]))

    def top(self, terms: np.ndarray, idf: np.ndarray, k: int, bound: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents' numbers and scores of the top k, and all that tie with the last; those without a term are left out."""
        known = terms >= 0
        terms, idf = terms[known], idf[known]
        row = self.dense_row[terms]
        rare, rows, weight = terms[row < 0], row[row >= 0], idf[row >= 0]
        counts = self.offsets[rare + 1] - self.offsets[rare]
        take = np.repeat(self.offsets[rare], counts) + _within(counts)
        score = np.bincount(self.docs[take], self.weights[take] * np.repeat(idf[row < 0], counts), self.blocks * BLOCK)
        upper = score + np.repeat(bound, BLOCK)
        slack = 2 * 10.0**-DIGITS  # what rounds to the last score ties with it
        open_ = np.flatnonzero(upper >= max(least - slack, 1e-12))
        if len(open_) > 8 * k:  # the best few first: their scores close most of the others
            head = open_[np.argpartition(-upper[open_], 2 * k)[: 2 * k]]
            first = np.sort(score[head] + weight @ self.dense[np.ix_(rows, head)])[-k]
            self.scored += len(head)
            least = max(least, first)
            open_ = open_[upper[open_] >= least - slack]
        pivots = open_[np.argsort(-upper[open_], kind="stable")]
        found, scores, step = np.zeros(0, np.int64), np.zeros(0), 64
        while len(pivots) and upper[pivots[0]] >= least - slack:
            now, pivots = pivots[:step], pivots[step:]
            now = now[upper[now] >= least - slack]
            self.scored += len(now)
            found, scores = np.concatenate([found, now]), np.concatenate([scores, score[now] + weight @ self.dense[np.ix_(rows, now)]])
            if len(scores) > k:
                least = max(least, float(np.partition(scores, len(scores) - k)[len(scores) - k]))
                keep = scores >= least - slack
                found, scores = found[keep], scores[keep]
            step *= 2
        keep = (scores > 0) & (found < self.n) & (scores >= least - slack)
        return found[keep], scores[keep]


class Best:
    """The top k of each query so far: scores, ids and whether an id is null, in order of rank."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.rows = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool))] * n

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        s, i, z = (np.concatenate(x) for x in zip(self.rows[q], (np.round(scores, DIGITS), ids, none)))
        order = np.lexsort((i, z, -s))[: self.k]
        self.rows[q] = s[order], i[order], z[order]
        if len(order) == self.k:
            self.least[q] = s[order][-1]


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "doc_id", query_text_col: str = "text", k1: float = 1.2, b: float = 0.75, shard_bytes: int = 20 << 20, block_bytes: int = 16 << 20) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: the k rows of ``docs`` with the highest BM25 score for each row of ``queries``.

    Terms are lower-cased runs of digits, letters and characters beyond ASCII; a query's different terms count once. idf is
    ln(1 + (N - df + 0.5) / (df + 0.5)) over all rows. Ties go to the smaller id, null last. Rows without a common term never appear, so
    null and empty texts match nothing. Rows of ``docs`` that repeat an id, or have none, are ranked apart, each under its own; queries need distinct ids,
    and those without one are left out. Texts are read whole, however long. Other columns may have any name. Empty tables give an empty table.

    Queries are sent to the shards in blocks of at most about ``block_bytes`` of text, one pass over the index for each.
    """
    spark = docs.sparkSession
    index = stable(build(docs, id_col, text_col, shard_bytes))
    n_docs, total = index.agg(F.sum(F.size("ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n_docs, total = n_docs or 0, total or 0
    mean = total / n_docs if n_docs else 0.0
    asked = stable(queries.select(F.col(query_id_col).cast("long").alias("q"), F.col(query_text_col).cast("string").alias("t")).where("q is not null and t is not null"))
    size = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    found = None
    for i in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).collect()
        terms = {r["q"]: np.array(sorted({_hash(w) for w in words(r["t"].encode())}), np.int64) for r in rows}
        every = np.unique(np.concatenate([*terms.values(), np.zeros(0, np.int64)]))
        sent_terms = spark.sparkContext.broadcast(every)

        def frequencies(batches: Iterator[pa.RecordBatch], sent=sent_terms) -> Iterator[pa.RecordBatch]:
            total_df = np.zeros(len(sent.value), np.int64)
            for batch in batches:
                for j in range(batch.num_rows):
                    row = batch.slice(j, 1)
                    own, offsets = (row.column(c).flatten().to_numpy() for c in ("terms", "offsets"))
                    if len(own):
                        at = np.minimum(np.searchsorted(own, sent.value), len(own) - 1)
                        total_df += np.where(own[at] == sent.value, np.diff(offsets)[at], 0)
            at = np.flatnonzero(total_df)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total_df[at])], ["at", "df"])

        df = np.zeros(len(every))
        for r in index.select("terms", "offsets").mapInArrow(frequencies, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).collect():
            df[r["at"]] = r["df"]
        idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
        sent = spark.sparkContext.broadcast(pickle.dumps([(q, t, idf[np.searchsorted(every, t)]) for q, t in terms.items() if len(t)], protocol=5))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = pickle.loads(sent.value)
            best = Best(len(block), k)
            for batch in batches:
                for j in range(batch.num_rows):
                    row = {c: batch.column(c).slice(j, 1).flatten() for c in batch.schema.names}
                    ids = row.pop("ids")
                    none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                    shard = Shard({c: x.to_numpy(zero_copy_only=False) for c, x in row.items()}, mean, k1, b)
                    for q, (d, s) in enumerate(shard.search([x[1:] for x in block], k, best.least)):
                        if len(d):
                            best.add(q, s, ids[d], none[d])
            sizes = [len(x[0]) for x in best.rows]
            if sum(sizes):
                s, d, z = (np.concatenate(x) for x in zip(*best.rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in block], sizes)), pa.array(d, pa.int64(), mask=z), pa.array(s)], ["query_id", "doc_id", "score"])

        one = index.mapInArrow(lean(search), "query_id long, doc_id long, score double")
        found = one if found is None else found.unionByName(one)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

