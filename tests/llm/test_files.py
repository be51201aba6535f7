import base64
import glob
import gzip
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corbel.llm import idcoder, tokenfile, warc

P = pytest.importorskip("public_tokenizers")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=400), st.integers(1, 90))
def test_coder_round_trip(ids, block):
    a = np.array(ids, np.int64)
    s = idcoder.encode(a, block)
    assert idcoder.decode(s).tolist() == ids
    assert len(s.words) == -(-len(ids) // block)


def test_coder_is_small_on_repeats_and_refuses_damage():
    a = np.tile(np.arange(50), 2_000)
    s = idcoder.encode(a)
    assert len(s.payload) < 0.2 * 2 * len(a)
    raw = bytearray(s.payload)
    raw[9] ^= 64
    s.payload = bytes(raw)
    with pytest.raises(ValueError):
        idcoder.decode(s)
    wide = np.arange(300_000)
    assert (idcoder.decode(idcoder.encode(wide, 4096)) == wide).all()


ODD = ["", "  ", "TAKSİ. İ! xİ,", "<|endoftext|> x", "<|ENDOFTEXT|> A", "a<|startoftext|>b,", "İstanbul ΣΑΣ. ς", "don't we'll, it's.", "éa,  b c", "\x1ca\x1db", "ﬁne² ½ 10,5.", "🙂🙂!! ok", "A,B;C", "ǅ, ß. ẞ", "naïve...", "a's, '", "»é,", " \n lead", "x " * 5_000]


def test_encoder_equals_the_tokenizer_on_whole_texts():
    from tokenizers import Tokenizer

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        own, real = tokenfile.Encoder(P.path(name), most=20), Tokenizer.from_file(P.path(name))
        assert own.by_word == (name == "word_bpe_49k.json")
        for group in (ODD, ODD[:1], ODD[5:9], ODD):
            ids, sizes = own.encode(pa.array(group))
            want = [e.ids for e in real.encode_batch(group, add_special_tokens=False)]
            assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


_ENCODER = tokenfile.Encoder(P.path("word_bpe_49k.json"))
_SIGN = st.sampled_from("İıßſKÅé\u0307\u0301ŉǅﬁ٣²Σς中Ж.,'!-() \t\n<|>aZ9")


@settings(max_examples=1_500, deadline=None)
@given(st.text(st.one_of(_SIGN, st.characters(exclude_categories=["Cs"])), max_size=40))
def test_encoder_equals_the_tokenizer_on_any_unicode(text):
    assert _ENCODER.encode(pa.array([text]))[0].tolist() == _ENCODER.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(i * 3 % 101, f"text number {i}, and {t}", "clash") for i, t in enumerate(ODD * 5)] + [(500, None, None), (None, "no id", None), (7, "again", None), (7, "again", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    path = str(tmp_path / "t")
    tokenfile.write(docs, path, P.path("word_bpe_49k.json"), segment=100, block=16)
    got = sorted(tokenfile.read(spark, path).collect(), key=lambda r: r.start)
    real = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = [(i, [*real.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    assert [r.doc_id for r in got] == [w[0] for w in want] and [r.ids for r in got] == [w[1] for w in want]
    assert [r.start for r in got] == np.cumsum([0] + [len(w[1]) for w in want])[:-1].tolist()
    short = {r.start: r.ids_crc32 for r in tokenfile.read(spark, path, summary=True).collect()}
    assert all(short[r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert not glob.glob(path + "/*.json")


def test_token_files_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    tokenfile.write(docs, str(tmp_path / "t"), P.path("word_bpe_49k.json"))
    assert tokenfile.read(spark, str(tmp_path / "t"), summary=True).count() == 0


def test_chunked_framing():
    for data in (b"", b"a", b"x" * 1000):
        assert warc.unchunked(warc.chunked(data, 7)) == data
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc", b"3\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def b32(html):
    return base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()


def test_warc_round_trip_with_segments_copies_and_odd_rows(spark, tmp_path):
    long_ = "é\r\n\r\nWARC/1.1\r\n" * 3_000
    rows = [(1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", long_), (4, "u", None), (5, "u", ""), (6, "u", long_), (7, "u", "y" * 90_000), (7, "u", "y" * 90_000), (None, "u", "z"), (8, "u", "only")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record string").repartition(3)
    path = str(tmp_path / "w")
    warc.write(pages, path, segment=1_000, chunk=300)
    got = warc.index(spark, path).collect()
    keep = {}
    for i, _, h in rows:
        if i is not None:
            keep[b32(h or "")] = max(i, keep.get(b32(h or ""), i))
    want = []
    for i, _, h in rows:
        k = keep.get(b32(h or ""), i)
        want.append((str(i), len((h or "").encode()), b32(h or ""), "response" if k == i else "revisit", None if k == i else k, True))
    assert sorted(map(str, ((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.complete) for r in got))) == sorted(map(str, want))
    whole = {r.record: r.payload for r in warc.read(spark, path).collect() if r.kind == "response"}
    assert any(bytes(p) == long_.encode() for p in whole.values())
    raw = b"".join(gzip.open(f).read() for f in glob.glob(path + "/*.gz"))
    assert raw.count(b"WARC-Type: continuation") > 100 and raw.count(b"WARC-Segment-Total-Length") == 3


def test_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u", "same")], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"), at_least=5)
    assert [r.record_type for r in warc.index(spark, str(tmp_path / "w")).collect()] == ["response"] * 2


def test_missing_segment_is_reported(spark, tmp_path):
    records = warc.records(9, "u", b"q" * 5_000, None, "2024-01-01T00:00:00Z", 1_000, 500)
    (tmp_path / "w").mkdir()
    for name, some in (("a", records), ("b", [r for k, r in enumerate(records) if k != 2])):
        with gzip.open(tmp_path / "w" / f"{name}.gz", "wb") as f:
            f.write(b"".join(r + warc.END for r in some))
        got = warc.read(spark, str(tmp_path / "w" / f"{name}.gz")).collect()
        assert [r.complete for r in got] == [name == "a"] and (got[0].payload is None) == (name == "b")


def test_empty_pages(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.index(spark, str(tmp_path / "w")).count() == 0
