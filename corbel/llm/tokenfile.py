"""Token-id files: documents in ascending id order, tokenized, coded block by block, and read back.

A file set is a Parquet folder. A row is a segment: some documents that follow each other, their ids and token counts, and
their ids as one stream coded by ``idcoder``. ``file`` and ``part`` order the segments; segments can be read one by one.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import idcoder
from .common import give_back, lean, slices

SEGMENT = "file int, part int, doc_ids array<long>, sizes array<long>, n long, block long, order0 binary, words array<long>, crcs array<long>, payload binary"
_ALNUM = frozenset(bytes([b]) for b in range(128) if chr(b).isalnum())
_SIGNS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum() and b != 39)  # of ASCII, but the apostrophe
_PLAIN = re.compile("[a-zß-öø-ÿ]+")  # lower-cased letters that normalization leaves alone
# how byte-level vocabularies write bytes: signs and letters as they are, the others from U+0100 on
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LEVEL = {b: chr(b) for b in _SELF} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SELF)}


def _closed(word: bytes) -> bool:
    """Whether signs after the word begin a token of their own: it ends in a digit or letter, lower-cased too, of the older Latin, Greek
    and Cyrillic blocks, which all Unicode versions class alike. (U+0130 does not: lower-cased it ends in a combining mark.)"""
    if word[-1:] in _ALNUM:
        return True
    last = word.decode("utf-8", "replace")[-1:]
    return "\x80" < last < "\u0530" and last.isalnum() and last.lower()[-1].isalnum()


class Encoder:
    """Ids of whole texts with a word cache.

    Words between ASCII white space are tokenized alone, which gives the same ids where the tokenizer drops white space and never
    joins what it separates (``word_bpe_49k`` does; the constructor checks a probe, and texts are tokenized whole if it
    fails). Signs at the end of a word that ends in a letter or digit are split off and A-Z lower-cased, as that tokenizer
    does, so that a word is tokenized once for all its forms. Words of plain lower-case letters go straight to the tokenizer's
    model, if that gives the same ids for all those letters in words of two and three. At about ``most`` held words the cache begins anew.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self._forget()
        # how the names of special tokens begin: words with one are tokenized as they are
        self.marks = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        # tokens that end a word, where the vocabulary marks them
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.tokenizer.get_vocab_size())], bool)
        letters = [c for c in map(chr, range(97, 256)) if _PLAIN.fullmatch(c)]
        words = [*letters, *(a + b for a, b in zip(letters, letters[1:] + letters[:1])), *(a + b + a for a in letters for b in letters[::7])]
        self.direct = all(self._model(w) == e.ids for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)))
        probe = "One two,  three.\n\tFour's (five) six-seven!! 8 9aé. ÇA ǅ X"
        self.by_word = True
        self.by_word = self.encode(pa.array([probe]))[0].tolist() == self.tokenizer.encode(probe, add_special_tokens=False).ids

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        """An empty cache: places of words and signs in ``start`` and ``size``, which cut ``flat`` into their ids."""
        self.words: dict[bytes, int] = {b"": 0}
        self.signs: dict[bytes, int] = {}
        self.flat, self.start, self.size = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _hold(self, flat: list[np.ndarray], size: list[np.ndarray]) -> int:
        """Appends ids, with the sizes of the entries; the place of the first."""
        first, sizes = len(self.size), np.concatenate([np.zeros(0, np.int64), *size])
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.flat = np.concatenate([self.flat, *flat])
        return first

    def _add(self, words: list[bytes]) -> int:
        """Tokenizes each alone; the place of the first."""
        flat, size = [], []
        for at in range(0, len(words), 20_000):
            ids = self._ids([w.decode("utf-8", "replace") for w in words[at : at + 20_000]])
            flat += ids
            size.append(np.fromiter(map(len, ids), np.int64, len(ids)))
        return self._hold(flat, size)

    def _model(self, word: str) -> list[int]:
        """Ids of a word of plain letters by the tokenizer's model alone."""
        if not word.isascii():
            word = "".join(_LEVEL[b] for b in word.encode())
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def _learn(self, need: list[bytes]) -> None:
        """Adds words: plain ones by the model; others of letters many at a time, cut where a word ends; the rest each alone."""
        plain, joined, alone = [], [], []
        for w in need:
            text = w.decode("utf-8", "replace")
            (plain if self.direct and _PLAIN.fullmatch(text) else joined if text.isalpha() else alone).append(w)
        tokenize, ids, ends = self.tokenizer.model.tokenize, [], []
        for w in plain:
            ids += [t.id for t in tokenize(w.decode() if w.isascii() else "".join(map(_LEVEL.__getitem__, w)))]
            ends.append(len(ids))
        known, flat, size = plain, [np.array(ids, "<u4")], [np.diff(np.array(ends, np.int64), prepend=0)]
        for at in range(0, len(joined), 2_000):
            some = joined[at : at + 2_000]
            own = self._ids([b" ".join(some).decode("utf-8", "replace")])[0]
            cuts = np.flatnonzero(self.ends[own]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(own):
                known = known + some
                flat.append(own)
                size.append(np.diff(cuts, prepend=0))
            else:  # a word that the tokenizer splits, or a vocabulary without marks
                alone += some
        first = self._hold(flat, size)
        self.words.update(zip(known, range(first, first + len(known))))
        first = self._add(alone)
        self.words.update(zip(alone, range(first, first + len(alone))))

    def _forms(self, forms: pa.Array, marked: bool) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the different forms and their numbers: of the word, then of the signs after it, which always begin a token of their own."""
        if len(self.words) + len(self.signs) > self.most:
            self._forget()
        bare = pc.ascii_rtrim(forms, characters=_SIGNS)
        tail = (pc.binary_length(forms).to_numpy() - pc.binary_length(bare).to_numpy()).astype(np.int64)
        coded = bare.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter(map(self.words.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(place < 0)
        need = [words[i] for i in new]
        whole = np.array([not _closed(w) for w in need], bool)
        learned = [w for w, x in zip(need, whole) if not x]
        self._learn(learned)
        place[new[~whole]] = np.fromiter(map(self.words.__getitem__, learned), np.int64, len(learned))
        word, odd = place[index], np.zeros(len(words), bool)
        odd[new[whole]] = True
        odd = odd[index]  # forms to be tokenized as they are
        for m in self.marks if marked else ():
            odd |= pc.match_substring(forms, m).to_numpy(zero_copy_only=False)
        sign = np.zeros(len(word), np.int64)
        for k in np.unique(tail[(tail > 0) & ~odd]):
            at = np.flatnonzero((tail == k) & ~odd)
            some = pc.utf8_slice_codeunits(forms.take(pa.array(at)), -int(k)).dictionary_encode()
            texts = some.dictionary.cast(pa.binary()).to_pylist()
            unseen = [t for t in texts if t not in self.signs]
            first = self._add(unseen)
            self.signs.update(zip(unseen, range(first, first + len(unseen))))
            sign[at] = np.fromiter(map(self.signs.__getitem__, texts), np.int64, len(texts))[some.indices.to_numpy(zero_copy_only=False)]
        both = np.stack([word, sign], 1)
        both[odd] = 0
        flat, start, size = self.flat, self.start[both], self.size[both]
        at = np.flatnonzero(odd)
        if len(at):
            own = self._ids(forms.take(pa.array(at)).to_pylist())
            size[at, 0] = np.fromiter(map(len, own), np.int64, len(own))
            start[at, 0] = len(flat) + np.cumsum(size[at, 0]) - size[at, 0]
            flat = np.concatenate([flat, *own])
        return _gather(flat, start.ravel(), size.ravel()), size.sum(1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and how many each text has. A few megabytes at a time."""
        if not self.by_word:
            each = self._ids(texts.to_pylist())
            return np.concatenate([*each, np.zeros(0, "<u4")]), np.array([len(x) for x in each], np.int64)
        held = texts.buffers()[2]
        held = held.to_pybytes() if held is not None else b""
        marked = any(m.encode() in held for m in self.marks)
        # A-Z is lower-cased by the tokenizer, but for what may be the name of a special token
        words = pc.ascii_split_whitespace(texts if marked else pc.ascii_lower(texts))
        offsets = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False)
        ids, size = self._forms(coded.dictionary, marked)
        start, counts = np.cumsum(size) - size, size[index]
        upto = np.concatenate([[0], np.cumsum(counts)])
        return _gather(ids, start[index], counts), np.diff(upto[offsets - offsets[0]])


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` one after another."""
    take = np.repeat(start - (np.cumsum(size) - size), size)
    take += np.arange(len(take))
    return flat[take]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most: int = 400_000) -> Encoder:
    """One per Python worker; its caches outlive a task."""
    if (path, most) not in _ENCODERS:
        _ENCODERS[path, most] = Encoder(path, most)
    return _ENCODERS[path, most]


def release() -> None:
    """Lets go of this worker's encoders: they hold hundreds of megabytes, and a worker lives on after the files are written."""
    _ENCODERS.clear()
    give_back()


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, segment: int = 2 << 20, block: int = 1024, cache: int = 400_000, piece: int = 4 << 20) -> None:
    """Writes the ids of all whole texts, each with ``end_id`` at its end, in ascending order of ``id_col``.

    Null texts are empty: their only id is the end. Null ids come first; equal ids follow each other in the order of their texts. A
    segment has ``segment`` ids and up to ``piece`` bytes of text more; a single longer document makes a longer one, which a task holds whole with its ids. A worker takes about 390 MB, with a ``cache`` of 100,000 words, half a million ids a segment and pieces of a megabyte about 260, at a third more time. Ids are
    integers, or cast to long; other columns are not read. An empty table makes an empty folder.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, part, own = TaskContext.get().partitionId(), 0, encoder(tokenizer, cache)
        ids: list = []
        sizes: list[int] = []
        streams: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            s = idcoder.encode(np.concatenate(streams), block)
            cells = [[file], [part], [ids], [sizes], [s.n], [s.block], [s.order0], [s.words], [s.crcs], [s.payload]]
            longs = pa.list_(pa.int64())
            kinds = [pa.int32(), pa.int32(), longs, longs, pa.int64(), pa.int64(), pa.binary(), longs, longs, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], ["file", "part", "doc_ids", "sizes", "n", "block", "order0", "words", "crcs", "payload"])

        for batch in slices(batches, "t", piece):
            stream, size = own.encode(batch.column("t"))
            ids += batch.column("id").to_pylist()
            sizes += (size + 1).tolist()
            streams.append(np.insert(stream, np.cumsum(size), end_id))
            held += len(streams[-1])
            if held >= segment:
                yield out()
                ids, sizes, streams, held, part = [], [], [], 0, part + 1
                give_back()
        if ids:
            yield out()

    # many rows of one id, or of none, are told apart by how their texts begin
    rows.repartitionByRange(F.col("id"), F.left("t", F.lit(64))).sortWithinPartitions("id", "t").mapInArrow(lean(run), SEGMENT).write.parquet(path)


def _offsets(segments: DataFrame) -> DataFrame:
    """``(file, part, before)``: ids in all segments before; files are summed up first, so the windows are short."""
    files = segments.groupBy("file").agg(F.sum("n").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("files_before"))
    parts = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.select("file", "part", F.coalesce(F.sum("n").over(parts), F.lit(0)).alias("parts_before"))
    return rows.join(files, "file").select("file", "part", (F.col("files_before") + F.col("parts_before")).alias("before"))


def read(spark: SparkSession, path: str, summary: bool = False) -> DataFrame:
    """Documents of a file set: ``(doc_id, start, n_tokens, ids: array<int>)``, with ``summary`` ``ids_crc32`` for ``ids``.

    ``start`` counts the ids of all documents before it, ``n_tokens`` has the end id. ``ids_crc32`` is that of the ids as
    little-endian unsigned 32-bit integers. A damaged block is an error.
    """
    stored = spark.read.schema(SEGMENT).parquet(path)
    kinds = "file int, part int, doc_id long, at long, n_tokens long, " + ("ids_crc32 long" if summary else "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for row in batch.to_pylist():
                s = idcoder.Segment(row["n"], row["block"], row["order0"], row["words"], row["crcs"], row["payload"])
                ids = idcoder.decode(s).astype("<u4")
                sizes = np.array(row["sizes"], np.int64)
                at = np.cumsum(sizes) - sizes
                own = [ids[a : a + k] for a, k in zip(at, sizes)]
                last = pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()) if summary else pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))
                m = len(sizes)
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * m, pa.int32()), pa.array([row["part"]] * m, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(at), pa.array(sizes), last], ["file", "part", "doc_id", "at", "n_tokens", "ids_crc32" if summary else "ids"])

    docs = stored.mapInArrow(lean(run), kinds)
    before = _offsets(stored.select("file", "part", "n"))
    return docs.join(before, ["file", "part"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32" if summary else "ids")
