"""Line dedup by a deletion neighbourhood; DataFrame functions only.

Equal lines are joined first. Whether a distinct line has another one edit away is narrowed down in two exact steps: such lines agree in
the first or the last half; and on a grid of 16 characters they agree before and after one window. Only windows that
are shared by different lines emit what they become by deleting one character, and themselves, as hashed keys together with what
stands around them. Two lines are one edit apart if and only if both give the same key by a deletion at the same place
(a substitution), or one gives by a deletion what the other is. Each key holds the earliest line, so groups are never
paired off; the edit distance to that line is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stable

BLANK = " \t\r"
WINDOW = 16


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _hash(t: Column) -> list[Column]:
    """128 bits of a line."""
    return [F.xxhash64(t).alias("h1"), F.xxhash64(F.lit("#"), t).alias("h2")]


def _halves(t: Column, min_chars: int) -> list[Column]:
    """Hashes of the first and last half, for its own and the next shorter length, as the other line may be shorter; null for short lines."""
    n = F.char_length(t)
    long_ = n >= min_chars
    out = []
    for k, cut in enumerate((F.floor(n / 2), F.floor((n - 1) / 2))):
        cut = cut.cast("int")
        use = long_ if k == 0 else long_ & (n % 2 == 0)
        out += [F.when(use, F.xxhash64(F.lit("first"), cut, F.substring(t, F.lit(1), cut))).alias(f"a{k}"), F.when(use, F.xxhash64(F.lit("last"), cut, F.right(t, cut))).alias(f"b{k}")]
    return out


HALVES = ("a0", "b0", "a1", "b1")


class Order:
    """Places of lines as numbers in their order: of documents ``low`` to ``high``, null last, with ``bits`` for the line in the document."""

    def __init__(self, low: int, high: int, bits: int):
        self.low, self.high, self.bits = low, high, bits
        self.narrow = (high + 2 - low) << bits < 1 << 63  # else 38 digits are needed

    def doc(self, doc: Column) -> Column:
        if self.narrow:
            return F.coalesce(doc, F.lit(self.high + 1)) - F.lit(self.low)
        return F.coalesce(doc.cast("decimal(20,0)"), F.lit(self.high + 1).cast("decimal(20,0)")) - F.lit(self.low).cast("decimal(20,0)")

    def place(self, doc: Column, pos: Column) -> Column:
        if self.narrow:
            return F.shiftleft(self.doc(doc), self.bits).bitwiseOR(pos.cast("long"))
        return (self.doc(doc).cast("decimal(21,0)") * F.lit(1 << self.bits).cast("decimal(10,0)") + pos).cast("decimal(38,0)")

    def pos(self, place: Column, doc: Column) -> Column:
        """The line's number in its document."""
        if self.narrow:
            return place.bitwiseAND(F.lit((1 << self.bits) - 1)).cast("int")
        return (place - self.doc(doc).cast("decimal(21,0)") * F.lit(1 << self.bits).cast("decimal(10,0)")).cast("int")


def near_earlier(lines: DataFrame) -> DataFrame:
    """``(h1, h2)`` of those of the distinct ``lines(h1, h2, at, t)`` that are one edit from an earlier one."""
    n, left = F.char_length("t"), F.col("i") * WINDOW
    size = lambda c: F.greatest(n - left - c, F.lit(0))

    def window(width: int) -> Column:
        right = size(width)
        return F.struct(F.xxhash64(left, F.substring("t", F.lit(1), left), right, F.right("t", right)).alias("around"), F.substring(F.col("t"), left + 1, n - left - right).alias("w"), F.lit(width).alias("width"))

    cells = lines.select("h1", "h2", "at", "t", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / WINDOW).cast("int"))).alias("i"))
    cells = cells.select("h1", "h2", "at", (size(WINDOW) > 0).alias("inner"), F.inline(F.array(window(WINDOW), window(WINDOW + 1))))
    parts = stable(cells.where((F.col("width") == WINDOW) | F.col("inner")).drop("inner", "width"))  # both windows at a line's end are the same
    shared = parts.groupBy("around").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("around")
    parts = parts.join(shared, "around").withColumn("place", F.explode(F.sequence(F.lit(0), F.char_length("w"))))
    cut = F.concat(F.substring(F.col("w"), F.lit(1), F.col("place") - 1), F.substring(F.col("w"), F.col("place") + 1, F.char_length("w")))
    v = stable(parts.select("h1", "h2", "at", "place", F.xxhash64("around", F.when(F.col("place") == 0, F.col("w")).otherwise(cut)).alias("key")))
    whole = v.groupBy("key").agg(F.min(F.when(F.col("place") == 0, F.col("at"))).alias("bare"), F.min(F.when(F.col("place") > 0, F.col("at"))).alias("cut"))
    same = v.where("place > 0").groupBy("key", "place").agg(F.min("at").alias("swap"))
    met = v.join(whole, "key").join(same, ["key", "place"], "left")
    met = met.withColumn("other", F.when(F.col("place") == 0, F.col("cut")).otherwise(F.least("bare", "swap"))).where("other < at")
    found = met.groupBy("h1", "h2").agg(F.min("other").alias("other"))
    pairs = found.join(lines.select("h1", "h2", "t"), ["h1", "h2"]).join(lines.select(F.col("at").alias("other"), F.col("t").alias("u")), "other")
    return pairs.where(F.levenshtein("t", "u", 1) >= 0).select("h1", "h2").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """Every row's ``(doc_id, text, n_lines, n_kept)`` without the lines that repeat an earlier line.

    A line, without blanks (space, tab, carriage return) at its ends, is dropped if an equal one stands before it, or, from ``min_chars``
    characters on (0 for all), if its first occurrence is one edit (insertion, deletion, substitution of a character) from the first
    occurrence of an earlier line of that length, whether or not that one is itself dropped. Earlier: in a document of a smaller
    id, or before it in the same. Blank lines stay. A null text stays null and has no lines, an empty one a blank one. Ids are
    integers, or cast to long (others fail); null ids come last; rows with equal ids count as one document, so copies of it with the same id keep
    the same lines, and a row with another text and the same id loses what stands at an earlier place of the first. Other columns may have any name. An empty table gives an empty table. The work in a row grows in proportion to its length.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).withColumn("own_text", F.xxhash64("text"))
    bare = rows.select("doc", "own_text", F.posexplode(_lines(F.col("text"))).alias("pos", "line")).select("doc", "own_text", "pos", _bare(F.col("line")).alias("t")).where("t <> ''")
    each = stable(bare.select("doc", "own_text", "pos", *_hash(F.col("t")), *_halves(F.col("t"), min_chars)))
    span = each.agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.max("pos").alias("pos"), F.count("*").alias("n")).first()
    order = Order(span["low"] or 0, span["high"] or 0, max(1, (span["pos"] or 0).bit_length()))
    at = order.place(F.col("doc"), F.col("pos"))
    firsts = stable(each.groupBy("h1", "h2").agg(F.min(at).alias("at"), F.count("*").alias("n"), *(F.min(c).alias(c) for c in HALVES)))
    halves = firsts.select("h1", "h2", "at", F.explode(F.array_compact(F.array(*HALVES))).alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("half")
    maybe = stable(halves.join(shared, "half").select("h1", "h2", "at").distinct())
    # the texts of these lines: each is cut out of its document
    wanted = each.select("doc", "h1", "h2", at.alias("at")).join(_small(maybe), ["h1", "h2", "at"]).select(order.doc(F.col("doc")).alias("number"), "at", "h1", "h2")
    whose = stable(wanted.distinct().groupBy("number").agg(F.collect_list(F.struct("at", "h1", "h2")).alias("lines")))
    cut = rows.withColumn("number", order.doc(F.col("doc"))).join(_small(whose), "number").select("doc", _lines(F.col("text")).alias("all"), F.explode("lines").alias("x")).select("x.*", "doc", "all")
    lines = cut.select("h1", "h2", "at", _bare(F.get("all", order.pos(F.col("at"), F.col("doc")))).alias("t"))
    lines = stable(lines.where(F.xxhash64("t") == F.col("h1")).groupBy("h1", "h2", "at").agg(F.first("t").alias("t")))
    near = near_earlier(lines).withColumn("near", F.lit(True))
    # lines to drop: first occurrences that are near an earlier line, and all later occurrences. Lines that are more than a ten-thousandth of all are few
    known = stable(firsts.select("h1", "h2", F.col("at").alias("first"), "n").join(near, ["h1", "h2"], "left").where("near or n > 1"))
    own = each.select("doc", "own_text", "pos", "h1", "h2", at.alias("own"))
    often = F.broadcast(known.where(F.col("n") > max(1_000, span["n"] // 10_000)).select("h1", "h2", "first", "near"))
    own = own.join(often, ["h1", "h2"], "left")
    hot, cold = own.where("first is not null"), own.where("first is null").drop("first", "near")
    cold = cold.join(known.where(F.col("n") <= max(1_000, span["n"] // 10_000)).drop("n"), ["h1", "h2"])
    gone = hot.unionByName(cold).where("near or own > first").groupBy(order.doc(F.col("doc")).alias("number"), "own_text").agg(F.collect_set("pos").alias("gone"))
    kept = rows.withColumn("number", order.doc(F.col("doc"))).join(gone, ["number", "own_text"], "left").withColumn("lines", _lines(F.col("text")))
    places = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1))
    kept = kept.withColumn("left", F.transform(F.array_except(places, F.coalesce("gone", F.array().cast("array<int>"))), lambda i: F.get("lines", i)))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join("left", "\n"))
    return kept.select("doc_id", text.alias("text"), size("lines").alias("n_lines"), F.when(F.col("gone").isNull(), size("lines")).otherwise(size("left")).alias("n_kept"))


def _small(rows: DataFrame) -> DataFrame:
    """Stable rows for a join: sent to all tasks up to 200,000, else shuffled."""
    return F.broadcast(rows) if rows.count() <= 200_000 else rows
