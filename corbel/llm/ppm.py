"""Language-model scores by prediction by partial matching over bytes.

Spark counts, over all training documents, each byte after its context of ``order`` bytes, and each word. The trie of contexts
of every shorter order follows from these counts. A byte unseen in its context costs an escape (method D) and is predicted by the
next shorter context, without the bytes that the longer one has ruled out; below order 0 all others are alike. The
probability of a byte depends on ``order + 1`` bytes only, so a chunk of documents asks for its distinct such strings.

The model grows with the training texts and no task holds it whole: strings are dealt out by the three bytes before the last one,
so each task has all longer contexts of the strings that it answers. Orders 0 to 2 are sent to all tasks. Answers go back to the chunks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, give_back, lean, slices, stable

END = 0xFF  # never in UTF-8: what stands before a text and what ends it
BUCKETS = 1024  # that strings are dealt to; a task takes one or more
SPREAD = 0x9E3779  # odd: multiplication by it permutes 24-bit numbers
GATHER = pow(SPREAD, -1, 1 << 24)


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each byte and end with the ``order`` bytes before it, and where each text begins."""
    pad, end = bytes([END]) * order, bytes([END])
    a = np.frombuffer(b"".join([x for t in texts for x in (pad, t, end)]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    codes = np.zeros(len(a) - order, np.uint64)
    for i in range(order + 1):
        codes <<= np.uint64(8)
        codes |= a[i : len(a) - order + i]
    begin = np.cumsum(sizes + order) - sizes - order
    keep = np.ones(len(codes) + order, bool)
    for i in range(1, order + 1):  # windows that end in the padding of the next text
        keep[begin[1:] - i] = False
    return codes[keep[: len(codes)]], np.cumsum(sizes) - sizes


def counts(train: DataFrame, text_col: str = "text", order: int = 5, hold: int = 300_000) -> DataFrame:
    """``(gram, word, n)``: over all lower-cased texts the count of each byte string (word null) and of each word (gram null), the empty word being the texts' ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        codes, ns = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out(codes: np.ndarray, ns: np.ndarray, words: Counter) -> pa.RecordBatch:
            grams_ = pa.concat_arrays([pa.array(codes.view(np.int64), pa.int64()), pa.nulls(len(words), pa.int64())])
            words_ = pa.concat_arrays([pa.nulls(len(codes), pa.binary()), pa.array(list(words), pa.binary())])
            return pa.RecordBatch.from_arrays([grams_, words_, pa.array(np.concatenate([ns, np.fromiter(words.values(), np.int64, len(words))]))], ["gram", "word", "n"])

        for batch in slices(batches, "t"):
            texts = [x.lower() for x in as_bytes(batch.column("t"))]
            new, n = np.unique(grams(texts, order)[0], return_counts=True)
            codes, ns = _summed(np.concatenate([codes, new]), np.concatenate([ns, n]))
            ns = ns.astype(np.int64)
            for t in texts:
                words.update(t.split())
            words[b""] += len(texts)
            if len(words) > hold or len(codes) > 5 * hold:
                yield out(codes, ns, words)
                words, codes, ns = Counter(), codes[:0], ns[:0]
        yield out(codes, ns, words)

    rows = train.select(F.col(text_col).cast("string").alias("t")).mapInArrow(lean(run), "gram long, word binary, n long")
    return rows.groupBy("gram", "word").agg(F.sum("n").alias("n"))


@dataclass
class Trie:
    """Of each order: sorted edges (context and byte) with counts; sorted contexts with their total, number of different bytes,
    and total of these bytes' counts in the context that is a byte shorter."""

    order: int
    edges: list[np.ndarray]
    seen: list[np.ndarray]
    contexts: list[np.ndarray]
    total: list[np.ndarray]
    kinds: list[np.ndarray]
    shorter: list[np.ndarray]

    @staticmethod
    def build(order: int, edges: list[np.ndarray], seen: list[np.ndarray]) -> Trie:
        t = Trie(order, edges, seen, [], [], [], [])
        for k in range(order + 1):
            ctx = edges[k] >> np.uint64(8)
            first = _firsts(ctx)
            ctx, inv = ctx[first], np.repeat(np.arange(len(first)), np.diff(first, append=len(ctx)))
            t.contexts.append(ctx)
            t.total.append(_small(np.bincount(inv, seen[k], len(ctx))))
            t.kinds.append(_small(np.bincount(inv, minlength=len(ctx))))
            low = seen[k - 1][np.searchsorted(edges[k - 1], edges[k] & _mask(k))] if k else np.zeros(len(inv))
            t.shorter.append(_small(np.bincount(inv, low, len(ctx))))
        t.seen = [_small(x) for x in seen]
        return t

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of each code after the bytes before it."""
        out = np.zeros(len(codes))
        open_ = np.arange(len(codes))
        gone, ruled = np.zeros(len(codes)), np.zeros(len(codes))  # counts and kinds that longer contexts have ruled out
        for k in range(self.order, -1, -1):
            code = codes[open_] & _mask(k + 1)
            c, known = _lookup(self.contexts[k], code >> np.uint64(8))
            e, hit = _lookup(self.edges[k], code)
            total, kinds = np.where(known, self.total[k][c] - gone[open_], 0.0) if len(c) else c, np.where(known, self.kinds[k][c] - ruled[open_], 0) if len(c) else c
            use = known & (kinds > 0)
            p = np.where(hit, 2.0 * self.seen[k][e] - 1, kinds) / np.maximum(2.0 * total, 1) if len(e) else total
            out[open_] += np.log10(np.where(use, p, 1.0))
            gone[open_], ruled[open_] = np.where(known, self.shorter[k][c], 0), np.where(known, self.kinds[k][c], 0)
            open_ = open_[~(hit & use)]
            if not len(open_):
                return out
        out[open_] -= np.log10(np.maximum(1, 256 - ruled[open_]))
        return out


def _small(x: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where these hold them exactly."""
    return x.astype(np.float32 if not len(x) or x.max() < 1 << 24 else np.float64)


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (8 * n)) - 1)


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def trie(counted: DataFrame, order: int = 5, most: int = 2_000_000) -> Trie | None:
    """The trie of stable ``counts``; None without training texts.

    A model has at most ``most`` edges, whatever the corpus: if all of them are more, contexts below the total that fits are left
    out (a context's suffixes have at least its total, so they stay), and their bytes are predicted by shorter contexts.
    """
    level = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k")
    by = counted.where("gram is not null").select("gram", "n", level)
    code = F.when(F.col("k") == order, F.col("gram")).otherwise(F.col("gram").bitwiseAND(F.element_at(F.array(*(F.lit((1 << (8 * (k + 1))) - 1) for k in range(order + 1))), F.col("k") + 1)))
    edges = stable(by.groupBy("k", code.alias("code")).agg(F.sum("n").alias("n")))
    if edges.count() > most:
        context = F.shiftrightunsigned("code", 8).alias("context")
        totals = stable(edges.groupBy("k", context).agg(F.sum("n").alias("total"), F.count("*").alias("edges")))
        # powers of 2 ** (1 / 8) of the total, at most a few hundred rows
        steps = totals.groupBy(F.floor(F.log2("total") * 8).alias("step")).agg(F.sum("edges").alias("edges")).orderBy(F.desc("step")).collect()
        held, cut = 0, None
        for r in steps:
            held += r["edges"]
            if held > most:
                break
            cut = r["step"]
        kept = totals.where(F.floor(F.log2("total") * 8) >= (cut if cut is not None else 1 << 20))
        edges = edges.withColumn("context", context).join(kept.select("k", "context"), ["k", "context"]).select("k", "code", "n")
    rows = edges.toArrow()
    ks, codes, ns = (rows.column(c).to_numpy() for c in ("k", "code", "n"))
    if not len(ks):
        return None
    split = []
    for k in range(order + 1):
        at = np.flatnonzero(ks == k)
        mine = codes[at].view(np.uint64)
        by_code = np.argsort(mine)
        split.append((mine[by_code], ns[at][by_code].astype(np.float64)))
    return Trie.build(order, [s[0] for s in split], [s[1] for s in split])


def _keys(codes: np.ndarray, order: int) -> np.ndarray:
    """Codes rearranged so that those of one bucket, and of one context of three bytes in it, are neighbours when sorted."""
    near = (codes >> np.uint64(8) & np.uint64(0xFFFFFF)) * np.uint64(SPREAD) & np.uint64(0xFFFFFF)
    return near << np.uint64(8 * max(order - 2, 1)) | codes >> np.uint64(32) << np.uint64(8) | codes & np.uint64(0xFF)


def _codes(keys: np.ndarray, order: int) -> np.ndarray:
    shift = 8 * max(order - 2, 1)
    near = (keys >> np.uint64(shift)) * np.uint64(GATHER) & np.uint64(0xFFFFFF)
    return (keys & np.uint64((1 << shift) - 1)) >> np.uint64(8) << np.uint64(32) | near << np.uint64(8) | keys & np.uint64(0xFF)


def _pack(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), "zstd", asbytes=True)


def _unpack(blob: bytes, n: int, kind: type) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, n * np.dtype(kind).itemsize, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(-1, n).T).view(kind).ravel()


def _unpack_keys(part: pa.Table) -> np.ndarray:
    blobs = zip(part.column("keys").to_pylist(), part.column("size").to_pylist())
    return np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(_unpack(b, n, np.uint64), dtype=np.uint64) for b, n in blobs)])


def _dealt(keys: np.ndarray, order: int) -> Iterator[tuple[int, slice]]:
    """Buckets of sorted keys, and where these are."""
    shift = np.uint64(8 * max(order - 2, 1) + 14)  # the ten highest of 24 bits
    cuts = np.searchsorted(keys >> shift, np.arange(BUCKETS + 1, dtype=np.uint64))
    return ((b, slice(cuts[b], cuts[b + 1])) for b in np.flatnonzero(np.diff(cuts)).tolist())


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where each value of a sorted array stands first."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))


def _distinct(x: np.ndarray) -> np.ndarray:
    """As ``np.unique``, which hashes the values when nothing but these is asked for: several times the work of sorting them."""
    x = np.sort(x)
    return x[_firsts(x)]


def _summed(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values with their sums; what is sorted in parts is merged."""
    by = np.argsort(x, kind="stable")
    x = x[by]
    first = _firsts(x)
    return x[first], np.add.reduceat(n[by].astype(np.float64), first) if len(x) else np.zeros(0)


class Places:
    """Where different keys stand in their array, by open addressing over whole arrays: sorting a chunk's strings again for a search costs several times as much."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.shift, self.mask = keys, np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._start(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], at[lost] + 1 & self.mask

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The places of keys that may repeat, in any order; an error if one is not there."""
        at = self._start(keys)
        out = self.slots[at]
        left = np.arange(len(keys))
        while True:
            if (out[left] < 0).any():
                raise KeyError("a string that was not asked for")
            wrong = self.keys[out[left]] != keys[left]
            left, at = left[wrong], at[wrong] + 1 & self.mask
            if not len(left):
                return out
            out[left] = self.slots[at]


def gathered(train: DataFrame, text_col: str = "text", order: int = 5, hold: int = 300_000) -> DataFrame:
    """What ``counts`` counts, before it is summed: packed keys with their counts by bucket, ``(low, n)`` of the strings of up to three bytes, and ``(word, n)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        keys, ns = np.zeros(0, np.uint64), np.zeros(0, np.float64)

        def out() -> pa.RecordBatch:
            parts = list(_dealt(keys, order))
            low, low_n = _summed(_codes(keys, order) & _mask(min(order, 2) + 1), ns)
            a, b, c = len(parts), len(low), len(words)
            full = lambda kind, before, x, after: pa.concat_arrays([pa.nulls(before, kind), pa.array(x, kind), pa.nulls(after, kind)])
            cells = [
                full(pa.int32(), 0, [k for k, _ in parts], b + c), full(pa.int32(), 0, [s.stop - s.start for _, s in parts], b + c),
                full(pa.binary(), 0, [_pack_keys(keys[s]) for _, s in parts], b + c), full(pa.binary(), 0, [_pack(ns[s].astype(np.uint32)) for _, s in parts], b + c),
                full(pa.int64(), a, low.astype(np.int64), c), full(pa.binary(), a + b, list(words), 0), full(pa.int64(), a, np.concatenate([low_n.astype(np.int64), np.fromiter(words.values(), np.int64, c)]), 0),
            ]
            return pa.RecordBatch.from_arrays(cells, ["bucket", "size", "keys", "ns", "low", "word", "n"])

        for batch in slices(batches, "t"):
            texts = [x.lower() for x in as_bytes(batch.column("t"))]
            new, n = np.unique(_keys(grams(texts, order)[0], order), return_counts=True)
            keys, ns = _summed(np.concatenate([keys, new]), np.concatenate([ns, n]))
            for t in texts:
                words.update(t.split())
            words[b""] += len(texts)
            if len(words) > hold or len(keys) > 5 * hold:
                yield out()
                words, keys, ns = Counter(), keys[:0], ns[:0]
        yield out()

    rows = train.select(F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(lean(run), "bucket int, size int, keys binary, ns binary, low long, word binary, n long")


def chunked(rows: DataFrame, order: int, most_bytes: int = 24 << 20, most_keys: int = 1_500_000) -> DataFrame:
    """``rows(id, t)`` in chunks: rows ``(chunk, ids, sizes, texts)`` of lower-cased texts, compressed together, and rows ``(chunk, bucket, size, keys)`` of a chunk's distinct keys, packed."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, keys = TaskContext.get().partitionId() << 32, 0, np.zeros(0, np.uint64)
        names, longs = ["chunk", "ids", "sizes", "texts", "bucket", "size", "keys"], pa.list_(pa.int64())
        list_kind = None

        def out() -> pa.RecordBatch:
            parts = list(_dealt(keys, order))
            n = len(parts)
            cells = [pa.array([k for k, _ in parts], pa.int32()), pa.array([s.stop - s.start for _, s in parts], pa.int32()), pa.array([_pack_keys(keys[s]) for _, s in parts], pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), pa.nulls(n, list_kind), pa.nulls(n, longs), pa.nulls(n, pa.binary()), *cells], names)

        for batch in slices(batches, "t", 2 << 20):
            texts = [x.lower() for x in as_bytes(batch.column("t"))]
            list_kind = pa.list_(batch.column("id").type)
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("id")).cast(list_kind)
            cells = [pa.array([chunk], pa.int64()), ids, pa.array([[len(x) for x in texts]], longs), pa.array([pa.compress(b"".join(texts), "zstd", asbytes=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*cells, pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())], names)
            keys, held = _distinct(np.concatenate([keys, _distinct(_keys(grams(texts, order)[0], order))])), held + sum(map(len, texts))
            if held > most_bytes or len(keys) > most_keys:
                yield out()
                chunk, held, keys = chunk + 1, 0, keys[:0]
        if len(keys):
            yield out()

    return rows.mapInArrow(lean(run), f"chunk long, ids array<{kind}>, sizes array<long>, texts binary, bucket int, size int, keys binary")


def answers(counted: DataFrame, asked: DataFrame, low: tuple[np.ndarray, np.ndarray], order: int, share: int = 1_500_000) -> DataFrame:
    """``(chunk, bucket, size, keys, logs)``: the asked keys' log10 probabilities under all counts, in 32 bits each, so that each, and a sum of them, is off by at most 6e-8 of itself. A task takes buckets of about ``share`` keys;
    there are 1,024 buckets, so that beyond about 1.5 thousand million keys a task's share grows."""
    levels = [_summed(low[0] & _mask(k + 1), low[1]) for k in range(min(order, 2) + 1)]
    sent = asked.sparkSession.sparkContext.broadcast(levels)
    n = sum(x.agg(F.sum("size")).first()[0] or 0 for x in (counted, asked))
    tasks = min(BUCKETS, max(1, -(-n // share)))

    def run(own: pa.Table, asks: pa.Table) -> pa.Table:
        known = list(sent.value)
        if own.num_rows and order > 2:
            ns = np.concatenate([_unpack(b, m, np.uint32) for b, m in zip(own.column("ns").to_pylist(), own.column("size").to_pylist())])
            codes, ns = _summed(_codes(_unpack_keys(own), order), ns)
            known += [_summed(codes & _mask(k + 1), ns) for k in range(3, order + 1)]
        model = Trie.build(len(known) - 1, [x[0] for x in known], [x[1] for x in known])
        unique, inverse = np.unique(_codes(_unpack_keys(asks), order), return_inverse=True)
        logs = model.log10(unique)[inverse]
        ends = np.cumsum(asks.column("size").to_numpy())
        out = asks.select(["chunk", "bucket", "size", "keys"]).append_column("logs", pa.array([_pack(x) for x in np.split(logs.astype(np.float32), ends[:-1])] if len(ends) else [], pa.binary()))
        give_back()
        return out

    task = (F.col("bucket") % tasks).alias("task")
    left, right = counted.select(task, "size", "keys", "ns"), asked.select(task, "chunk", "bucket", "size", "keys")
    return left.groupBy("task").cogroup(right.groupBy("task")).applyInArrow(run, "chunk long, bucket int, size int, keys binary, logs binary")


def scores(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 5, most: int | None = None, common: int = 100_000) -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``, learned from all of ``train``.

    Texts are lower-cased (A-Z); null is empty. ``score`` is the trie's log10 probability of all bytes and the end, ``base_score`` that of
    the words and one end under smoothed word counts. At most ``common`` frequent words are sent to the tasks; the
    others are looked up by a join. Rows that repeat an id, or have none, keep their own rows, and equal texts score alike. Texts are read whole; a very long one makes a
    chunk of its own, held whole with its strings. Other columns may have any name. Without training texts all bytes are alike, and an empty table gives an empty one.
    All contexts are kept; with ``most`` the model is cut to so many edges (see ``trie``) and sent to the tasks.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be 1 to 6")
    spark = docs.sparkSession
    if most is None:
        counted = stable(gathered(train, text_col, order))
        words = stable(counted.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
        lows = counted.where("low is not null").groupBy("low").agg(F.sum("n").alias("n")).toArrow()
        low = lows.column("low").to_numpy().view(np.uint64), lows.column("n").to_numpy()
    else:
        counted = stable(counts(train, text_col, order))
        words = counted.where("word is not null")
    n_all, v_all = (x or 0 for x in words.agg(F.sum("n"), F.count("*")).first())
    # how many words have each count, from the most frequent on: a threshold that keeps at most `common` words
    step = F.floor(F.log2("n") * 16)
    cut, held = None, 0
    for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("c")).orderBy(F.desc("step")).collect():
        held += r["c"]
        if held > common:
            break
        cut = r["step"]
    often = step >= F.lit(cut if cut is not None else 1 << 20)
    frequent = {bytes(r["word"]): r["n"] for r in words.where(often).select("word", "n").collect()}
    model = None if most is None else trie(counted, order, most)
    log = {w: float(np.log10(n + 1)) for w, n in frequent.items()}
    sent = spark.sparkContext.broadcast((model, log))
    del model, frequent, log

    def score(ids: pa.Array, texts: list[bytes], asked: tuple[Places, np.ndarray] | None) -> pa.RecordBatch:
        own, log = sent.value
        if own is None and asked is None:
            total = np.array([-(len(t) + 1) * np.log10(256.0) for t in texts])
        else:
            codes, begin = grams(texts, order)
            if asked is None:
                unique, inverse = np.unique(codes, return_inverse=True)
                logs = own.log10(unique)[inverse]
            else:
                logs = asked[1][asked[0].of(_keys(codes, order))]
            total = np.add.reduceat(logs, begin)
        sizes, known, base, rare, times = [], [], [], [], []
        for t in texts:
            w = t.split()
            w.append(b"")
            found = [log[x] for x in w if x in log]
            more = Counter(x for x in w if x not in log) if len(found) < len(w) else {}
            sizes.append(len(w))
            known.append(len(found))
            base.append(sum(found))
            rare.append(list(more))
            times.append(list(more.values()))
        cells = [ids, pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cells, ["id", "n_tokens", "known", "base", "score", "rare", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 2 << 20):
            yield score(batch.column("id"), [x.lower() for x in as_bytes(batch.column("t"))], None)

    def of_chunk(texts: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("bucket")
        logs = np.concatenate([np.zeros(0), *(_unpack(b, n, np.float32).astype(np.float64) for b, n in zip(found.column("logs").to_pylist(), found.column("size").to_pylist()))])
        asked, out = (Places(_unpack_keys(found)), logs), []
        for i in range(texts.num_rows):
            ids, sizes, blob = (texts.column(c)[i] for c in ("ids", "sizes", "texts"))
            ends = np.cumsum(sizes.values.to_numpy())
            raw = pa.decompress(blob.as_py(), int(ends[-1]), "zstd", asbytes=True)
            out.append(score(ids.values, [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], asked))
        done = pa.Table.from_batches(out)
        del out, asked, found
        give_back()
        return done

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kinds = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, known long, base double, score double, rare array<binary>, times array<long>"
    if most is None and len(low[0]):
        chunks = stable(chunked(rows, order))
        found = answers(counted.where("bucket is not null"), chunks.where("bucket is not null"), low, order)
        scored = chunks.where("bucket is null").select("chunk", "ids", "sizes", "texts").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(of_chunk, kinds)
    else:
        scored = rows.mapInArrow(lean(run), kinds)
    done = stable(scored.withColumn("row", F.monotonically_increasing_id()))
    asked = done.select("row", F.inline(F.arrays_zip("rare", "times"))).withColumnRenamed("rare", "word")
    more = asked.join(words.where(~often).select("word", "n"), "word").groupBy("row").agg(F.sum("times").alias("k"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("b"))
    all_ = done.drop("rare", "times").join(more, "row", "left")
    base = F.col("base") + F.coalesce("b", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n_all + v_all + 1)))
    return all_.select("id", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
