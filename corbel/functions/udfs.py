"""Arrow-batched helpers for what Spark has no expression for: Unicode forms, HTML trees, keyed hashes, wide decimals."""

from __future__ import annotations

import decimal
import hashlib
import hmac
import html.parser
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alikes of Latin letters: fixed values.
HOMOGLYPHS = dict(zip("аеорсхуАВЕКМНОРСТХУ", "aeopcxyABEKMHOPCTXY"))
ZERO_WIDTH = set("\u200b\u200c\u200d\u2060\ufeff")
BIDI = {"\u061c", "\u200e", "\u200f", *map(chr, range(0x202A, 0x202F)), *map(chr, range(0x2066, 0x206A))}


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TEXT = T.StringType()
FINDING = _struct(kind=TEXT, source_start=T.IntegerType(), source_end=T.IntegerType())
CANONICAL = _struct(content=TEXT, digest=TEXT, raw_digest=TEXT, findings=T.ArrayType(FINDING))
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e]*")
_PIECE = re.compile(r"[\t\n\r\x20-\x7e]+|.", re.DOTALL)  # plain characters together, others alone
_SPACE = re.compile("[\\s\\ufeff]+")


def _sha(text: str) -> str:
    return "sha256:" + hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def sliced(arrays: tuple[pa.Array, ...], most: int = 1 << 18) -> Iterator[tuple[list, ...]]:
    """The values of a batch, the first array being texts, in parts of about ``most`` bytes of text: results that are larger than their texts never stand for a whole batch at once."""
    start = held = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(arrays[0]), 0).to_pylist()):
        held += size
        if held >= most or i + 1 - start >= 1_000:
            yield tuple(a.slice(start, i + 1 - start).to_pylist() for a in arrays)
            start, held = i + 1, 0
    if start < len(arrays[0]):
        yield tuple(a.slice(start).to_pylist() for a in arrays)


def _rows(names: tuple[str, ...], rows: list[tuple | None], kind: pa.DataType) -> pa.Array:
    return pa.array([None if r is None else dict(zip(names, r)) for r in rows], kind)


def canonical_text(text: str) -> tuple[str, list[tuple[str, int, int]]]:
    """NFKC without invisible and control characters, look-alikes folded; each change as (kind, start, end) in code points."""
    if _PLAIN.fullmatch(text):
        return text, []
    out, found = [], []
    for m in _PIECE.finditer(text):
        c, i = m.group(), m.start()
        if len(c) > 1 or _PLAIN.fullmatch(c):
            out.append(c)
        elif c in ZERO_WIDTH:
            found.append(("zero_width", i, i + 1))
        elif c in BIDI:
            found.append(("bidirectional_control", i, i + 1))
        elif ord(c) < 32 or 127 <= ord(c) < 160:
            found.append(("control_character", i, i + 1))
        else:
            twin = HOMOGLYPHS.get(c)
            new = twin or unicodedata.normalize("NFKC", c)
            if new != c:
                found.append(("unicode_normalized", i, i + 1))
            if twin:
                found.append(("homoglyph", i, i + 1))
            out.append(new)
    return unicodedata.normalize("NFKC", "".join(out)), found


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("source_start", pa.int32()), ("source_end", pa.int32())]))
_CANONICAL = pa.struct([("content", pa.string()), ("digest", pa.string()), ("raw_digest", pa.string()), ("findings", _FOUND)])


@F.arrow_udf(CANONICAL)
def _canonicalize(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for (texts,) in sliced((batch,)):
            rows = [(t, *canonical_text(t)) for t in texts]
            yield _rows(CANONICAL.names, [(c, _sha(c), _sha(t), [dict(zip(FINDING.names, f)) for f in found]) for t, c, found in rows], _CANONICAL)


@F.arrow_udf(TEXT)
def canonical_content(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The content of ``canonicalize`` alone."""
    for batch in batches:
        for (texts,) in sliced((batch,)):
            yield pa.array([None if t is None else canonical_text(t)[0] for t in texts], pa.string())


def canonicalize(text: Column) -> Column:
    """``struct(content, digest, raw_digest, findings)`` of a text; a null text gives null."""
    return F.when(text.isNotNull(), _canonicalize(F.coalesce(text, F.lit(""))))


@F.arrow_udf(TEXT)
def nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for (texts,) in sliced((batch,)):
            yield pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts], pa.string())


RUN = T.StructType([T.StructField(c, T.IntegerType()) for c in ("canonical_start", "canonical_end", "source_start", "source_end")] + [T.StructField("same", T.BooleanType())])
MAPPED = T.StructType([T.StructField("content", TEXT), T.StructField("runs", T.ArrayType(RUN))])


def canonical_runs(text: str) -> tuple[str, list[tuple[int, int, int, int, bool]]]:
    """``canonical_text``'s content, and where it comes from in code points: runs that are the same, and changed ones, whose characters can't be told apart.

    A character and the marks that combine with it are normalized together. Where more than that grows together (Hangul letters), the whole text is one run.
    """
    content, _ = canonical_text(text)
    if content == text:
        return content, [(0, len(text), 0, len(text), True)] if text else []
    out, parts, at, unit = [], [], 0, None

    def put(new: str, start: int, end: int, same: bool) -> None:
        nonlocal at
        last = out[-1] if out else None
        if same and last and last[4] and last[3] == start:
            out[-1] = (last[0], at + len(new), last[2], end, True)
        else:
            out.append((at, at + len(new), start, end, same))
        parts.append(new)
        at += len(new)

    def settle() -> None:
        if unit:
            first, own, start, end = unit
            new = unicodedata.normalize("NFKC", own)
            put(new, start, end, new == first and end == start + 1)

    for m in _PIECE.finditer(text):
        c, i = m.group(), m.start()
        if len(c) > 1:  # plain ones; the last may have marks behind it
            settle()
            put(c[:-1], i, m.end() - 1, True)
            unit = [c[-1], c[-1], m.end() - 1, m.end()]
        elif c in ZERO_WIDTH or c in BIDI or (ord(c) < 32 and c not in "\t\n\r") or 127 <= ord(c) < 160:
            continue
        elif unit and unicodedata.combining(c):
            unit[1] += HOMOGLYPHS.get(c) or c
            unit[3] = i + 1
        else:
            settle()
            unit = [c, HOMOGLYPHS.get(c) or c, i, i + 1]
    settle()
    if "".join(parts) != content:
        return content, [(0, len(content), 0, len(text), False)]
    return content, out


@F.arrow_udf(MAPPED)
def canonical_mapped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Canonical texts with their runs."""
    kind = pa.struct([("content", pa.string()), ("runs", pa.list_(pa.struct([(c, pa.bool_() if c == "same" else pa.int32()) for c in RUN.names])))])
    for batch in batches:
        for (texts,) in sliced((batch,)):
            rows = ((None, None) if t is None else canonical_runs(t) for t in texts)
            yield _rows(MAPPED.names, [(c, None if runs is None else [dict(zip(RUN.names, r)) for r in runs]) for c, runs in rows], kind)


def spans_of(text: str, spans: list[dict]) -> list[tuple[int, int] | None]:
    """Where spans of the canonical form stand in a text, as ``text.source_span`` has it."""
    runs = canonical_runs(text)[1] if spans else []
    starts, ends, out = [r[0] for r in runs], [r[1] for r in runs], []
    for s in spans:
        i, k = bisect_right(ends, s["start"]), bisect_left(starts, s["end"]) - 1
        if i > k:
            out.append(None)
            continue
        first, last = runs[i], runs[k]
        out.append((first[2] + s["start"] - first[0] if first[4] else first[2], last[2] + s["end"] - last[0] if last[4] else last[3]))
    return out


def source_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over ``(id, text, found)``: where findings, an array of ``(rule_id, start, end)`` in the canonical form of a text, stand in the text itself, and the digest of what stands there, a row each.

    The runs of a text are made, searched and dropped.
    """
    names = ("rule_id", "start", "source_start", "source_end", "cut_md5")
    for batch in batches:
        ids, texts, all_ = batch.columns
        for part, some, of in sliced((texts, all_, ids)):
            rows = []
            for text, found, key in zip(part, some, of):
                for f, span in zip(found or (), spans_of(text, found or [])):
                    a, b = span or (None, None)
                    rows.append((key, f["rule_id"], f["start"], a, b, None if a is None else hashlib.md5(text[a:b].encode("utf-8", "surrogatepass")).hexdigest()))
            kinds = (ids.type, pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[batch.schema.names[0], *names])


@F.pandas_udf(T.ArrayType(TEXT))
def nfkc_each(lists: pd.Series) -> pd.Series:
    """NFKC of the texts of an array."""
    return lists.map(lambda ts: None if ts is None else [None if t is None else unicodedata.normalize("NFKC", t) for t in ts])


@F.pandas_udf(TEXT)
def unaccented(texts: pd.Series) -> pd.Series:
    """Letters without their marks (NFKD)."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


LINK = _struct(href=TEXT, text=TEXT)
REGION = _struct(reason=TEXT, tag=TEXT, text=TEXT)
PAGE = _struct(format=TEXT, title=TEXT, metadata=T.MapType(TEXT, TEXT), links=T.ArrayType(LINK), hidden=T.ArrayType(REGION), content=TEXT)
INACTIVE = {"script", "style", "template", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Page(html.parser.HTMLParser):
    """Visible text, first metadata, links and hidden regions in document order. End tags close the nearest open tag of their name; trees are not repaired further."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.names: Counter = Counter()  # of open tags
        self.pieces: list[str] = []  # all text; a node's own begins at its start
        self.visible: list[str] = []
        self.metadata: dict[str, str] = {}
        self.links: list[dict] = []
        self.hidden: list[dict] = []
        self.title: str | None = None

    @property
    def concealed(self) -> bool:
        return bool(self.open) and self.open[-1]["concealed"]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        style = re.sub(r"\s+", "", a.get("style", "")).lower()
        reason = "inactive_content" if tag in INACTIVE else "hidden_attribute" if "hidden" in a or a.get("aria-hidden") == "true" else "hidden_css" if "display:none" in style or "visibility:hidden" in style else None
        node = {"tag": tag, "start": len(self.pieces), "concealed": self.concealed or reason is not None, "region": None, "link": None}
        if reason:
            node["region"] = {"reason": reason, "tag": tag, "text": ""}
            self.hidden.append(node["region"])
        if tag == "meta":
            key, value = a.get("name", a.get("property", a.get("http-equiv"))), a.get("content")
            if key is not None and value is not None:
                self.metadata.setdefault(key.lower(), value)
        if tag == "link" and a.get("rel", "").lower() == "canonical" and "href" in a:
            self.metadata["canonical"] = a["href"]
        if tag == "a" and "href" in a and not node["concealed"]:
            node["link"] = {"href": a["href"], "text": ""}
            self.links.append(node["link"])
        if tag not in VOID:
            self.open.append(node)
            self.names[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)
        if not self.concealed:
            self.visible.append(data)

    def handle_endtag(self, tag: str) -> None:
        if self.names[tag]:
            while self._close() != tag:
                pass

    def _close(self) -> str:
        node = self.open.pop()
        self.names[node["tag"]] -= 1
        if node["region"] is None and node["link"] is None and (node["tag"] != "title" or self.title is not None):
            return node["tag"]
        text = _SPACE.sub(" ", "".join(self.pieces[node["start"] :])).strip()
        for kind in ("region", "link"):
            if node[kind] is not None:
                node[kind]["text"] = text
        if node["tag"] == "title" and self.title is None and text:
            self.title = text
        return node["tag"]

    def finish(self) -> None:
        self.close()
        while self.open:
            self._close()
        self.hidden = [r for r in self.hidden if r["text"]]


def parse_page(raw: str, declared: str | None = None) -> tuple:
    """A page's parts, all of it; only its format is told by how it begins."""
    probe = raw.lstrip()[:512].lower()
    declared = declared or ""
    kind = "rss" if "rss" in declared or re.match(r"<rss[\s>]", probe) else "atom" if "atom" in declared or re.match(r"<feed[\s>]", probe) else "text" if declared.startswith("text/plain") else "html" if re.search(r"</?[a-z][^>]*>", probe) else "text"
    if kind == "text":
        return kind, None, {}, [], [], _SPACE.sub(" ", raw).strip()
    page = _Page()
    page.feed(raw)
    page.finish()
    return kind, page.title, page.metadata, page.links, page.hidden, _SPACE.sub(" ", " ".join(page.visible)).strip()


_LINKS, _REGIONS = (pa.list_(pa.struct([(c, pa.string()) for c in kind.names])) for kind in (LINK, REGION))
_PAGE = pa.struct([("format", pa.string()), ("title", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("links", _LINKS), ("hidden", _REGIONS), ("content", pa.string())])


@F.arrow_udf(PAGE)
def _parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for (pages,) in sliced((batch,)):
            rows = map(parse_page, pages)
            yield _rows(PAGE.names, [(kind, title, list(metadata.items()), *rest) for kind, title, metadata, *rest in rows], _PAGE)


def parse_html(page: Column) -> Column:
    """``struct(format, title, metadata, links, hidden, content)``; a null page is an empty text."""
    return _parse(F.coalesce(page, F.lit("")))


def keyed_digest(text: Column, secret: str) -> Column:
    """HMAC-SHA256 with the digest prefix."""

    @F.pandas_udf(TEXT)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "sha256:" + hmac.new(secret.encode(), t.encode(), hashlib.sha256).hexdigest())

    return run(text)


def signed(body: Column, at: Column, signature: Column, secret: str, now_s: Column, tolerance_s: int = 300) -> Column:
    """Whether a delivery's signature ``v1=<hex>`` is the HMAC-SHA256 of ``timestamp.body`` and its time is within the tolerance."""

    @F.pandas_udf(T.BooleanType())
    def run(bodies: pd.Series, times: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series([None not in (b, t, g) and hmac.compare_digest("v1=" + hmac.new(secret.encode(), f"{t}.{b}".encode(), hashlib.sha256).hexdigest(), g) for b, t, g in zip(bodies, times, given)])

    return run(body, at.cast("string"), signature) & (F.abs(now_s - at) <= tolerance_s)


CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def crockford(raw: bytes) -> str:
    """16 bytes as 26 characters."""
    n, out = int.from_bytes(raw, "big"), ""
    for _ in range(26):
        out, n = CROCKFORD[n & 31] + out, n >> 5
    return out


def stable_id(prefix: str, text: Column, secret: str) -> Column:
    """The same id for the same text and secret."""

    @F.pandas_udf(TEXT)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f"{prefix}_{crockford(hmac.new(secret.encode(), t.encode(), hashlib.sha256).digest()[:16])}")

    return run(text)


@F.pandas_udf(TEXT)
def decimal_sum(lists: pd.Series) -> pd.Series:
    """Exact sum of decimal texts of up to 100 digits, zeros at the end stripped; null if one is no decimal."""

    def one(xs) -> str | None:
        if xs is None or any(x is None or len(x) > 100 or not re.fullmatch(r"-?\d+(\.\d+)?", x) for x in xs):
            return None
        with decimal.localcontext() as c:
            c.prec = 250
            text = format(sum(map(decimal.Decimal, xs), decimal.Decimal(0)), "f")
        return (text.rstrip("0").rstrip(".") if "." in text else text) or "0"

    return lists.map(one)
