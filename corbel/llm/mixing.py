"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

A source's target over its size is how often its words are taken. The whole part is certain: every document is copied so
often. The rest is left to chance with an inclusion chance pi of each document's own, in proportion to its size and 1 at most, such that the
expected words are the rest. Documents are ranked by u/(1-u) over pi/(1-pi), u a hash of the id in (0, 1), and taken in
this order until the words that remain to the target are reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stable

WEIGHTS = (5, 2, 1)
PLACES = 1 << 16


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and \\t\\n\\v\\f\\r; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column) -> Column:
    """A number inside (0, 1) from the md5 of the id as text; reruns agree."""
    digits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double")
    return (digits + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = 3) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``: ``share`` of all words dealt by weight, none above ``most`` times its source.

    Sources by code point, null last, weigh ``weights``, repeating. What is above a cap is dealt again to the others by
    weight until none is above: sources in order of cap over weight are full as long as the level of the others is
    above theirs. The windows run over one row a source.
    """
    order, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "k")
    kept = sizes.withColumn("k", F.row_number().over(order) - 1)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("k") % len(weights) + 1).cast("int"))
    kept = kept.withColumn("w", w).withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    kept = kept.withColumn("level", (total * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after))
    # the first source in order whose cap is not reached sets the level of all that follow
    kept = kept.withColumn("full", F.col("ratio") <= F.col("level"))
    common = F.min(F.when(~F.col("full"), F.struct("ratio", "k", "level"))).over(Window.partitionBy())
    kept = kept.withColumn("common", common)
    open_ = F.col("common").isNotNull() & ((F.col("ratio") > F.col("common.ratio")) | ((F.col("ratio") == F.col("common.ratio")) & (F.col("k") >= F.col("common.k"))))
    return kept.select("source", "source_size", F.when(open_, F.col("w") * F.col("common.level")).otherwise(F.col("cap").cast("double")).alias("target"))


def _key(source: Column) -> Column:
    """A source's join key; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def chances(by_size: DataFrame, goal: DataFrame) -> DataFrame:
    """``(key, top, rate)``: documents of at most ``top`` words have the chance ``rate`` a word, longer ones are certain.

    ``by_size(key, size, n)`` counts each source's documents of each size, ``goal(key, source_size, rest)`` says what is to be taken. With
    all sizes above t certain, the rate of the others is (rest - words above t) / (squares up to t); the largest t whose chance stays
    below 1 is right. The window runs over a source's different sizes.
    """
    upto = Window.partitionBy("key").orderBy("size")
    rows = by_size.where("size > 0").join(goal.where("rest > 0").select("key", "source_size", "rest"), "key")
    words = F.sum(F.col("n") * F.col("size")).over(upto)
    squares = F.sum(F.col("n").cast("double") * F.col("size") * F.col("size")).over(upto)
    rows = rows.withColumn("rate", (F.col("rest") - (F.col("source_size") - words)) / squares).where(F.col("rate") * F.col("size") <= 1)
    best = rows.groupBy("key").agg(F.max(F.struct("size", "rate")).alias("best"))
    return best.select("key", F.col("best.size").alias("top"), F.col("best.rate").alias("rate"))


def _edge(words: DataFrame, place: str) -> DataFrame:
    """Of ``words(key, before, rest, place, words)`` the first place of each key in which ``rest`` is exceeded, and the words before it."""
    run = Window.partitionBy("key").orderBy(place)
    words = words.withColumn("upto", F.col("before") + F.sum("words").over(run)).where("upto > rest")
    edge = words.groupBy("key").agg(F.min(F.struct(place, F.expr("upto - words").alias("before"))).alias("edge"))
    return edge.select("key", f"edge.{place}", "edge.before")


def _small(rows: DataFrame) -> DataFrame:
    """Stable rows, one a source, for a join: sent to all tasks up to 100,000, else shuffled."""
    return F.broadcast(rows) if rows.count() <= 100_000 else rows


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = 3) -> DataFrame:
    """One row per source of stable ``rows(source, size, u, id)``: ``(key, source_size, target, whole, rest, top, rate, edge, last)``.

    Ranks are never formed in one task: the order is cut into 256 times 256 places, and words are added up by (source, place), first coarse,
    then within the place in which the source's remaining words are reached; ``edge`` is that place. Only its documents
    are ordered one by one, and ``last`` is the point of the order up to which they are taken.
    """
    rows = rows.withColumn("key", _key(F.col("source")))
    by_size = stable(rows.groupBy("key", "size").agg(F.count("*").alias("n"), F.first("source").alias("source")))
    goal = targets(by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = stable(goal.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("key", _key(F.col("source"))).drop("source"))
    goal = stable(goal.join(chances(by_size, goal), "key", "left"))
    ranked = rows.join(_small(goal.select("key", "rest", "top", "rate")), "key").withColumn("odds", _odds()).where("odds is not null").withColumn("place", _place())
    coarse, fine = F.shiftright("place", 8).alias("coarse"), F.col("place")
    first = _edge(ranked.groupBy("key", coarse).agg(F.first("rest").alias("rest"), F.lit(0).cast("long").alias("before"), F.sum("size").alias("words")), "coarse")
    first = stable(first)
    inside = ranked.withColumn("coarse", coarse).join(_small(first), ["key", "coarse"])
    second = _edge(inside.groupBy("key", fine).agg(F.first("rest").alias("rest"), F.first("before").alias("before"), F.sum("size").alias("words")), "place")
    second = stable(second.select("key", F.col("place").alias("edge"), "before"))
    at_edge = ranked.join(_small(second), "key").where("place = edge")
    order = Window.partitionBy("key").orderBy("odds", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_edge = at_edge.withColumn("end", F.col("before") + F.sum("size").over(order))
    # the document on the target itself is taken if that comes nearer
    start = F.col("end") - F.col("size")
    near = (F.col("end") <= F.col("rest")) | ((start < F.col("rest")) & (F.col("end") - F.col("rest") < F.col("rest") - start))
    last = at_edge.where(near).groupBy("key").agg(F.max(F.struct("odds", "id", "size")).alias("last"))
    return goal.join(second.select("key", "edge"), "key", "left").join(last, "key", "left")


def _odds() -> Column:
    """u's odds over those of the document's inclusion chance: 0 for certain ones; null for those that are not drawn at all."""
    pi = F.col("rate") * F.col("size")
    drawn = (F.col("rest") > 0) & (F.col("size") > 0) & F.col("rate").isNotNull()
    return F.when(drawn & ((F.col("size") > F.col("top")) | (pi >= 1)), F.lit(0.0)).when(drawn & (pi > 0), (F.col("u") / (1 - F.col("u"))) / (pi / (1 - pi)))


def _place() -> Column:
    """Odds as one of 65,536 places in their order."""
    return F.floor(F.col("odds") / (1 + F.col("odds")) * PLACES).cast("int")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = 3, carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, size, source_size, target, copies)``, with ``carry`` all columns of ``docs``
    as a struct ``row`` too.

    A null source is a source of its own; null ids and texts count as empty. Sources without a word have target 0 and no
    copies; documents without a word are copied for the whole part only. Rows with equal ids and sizes share a rank. Other columns may have any
    name. Very long texts are counted where they are. An empty table gives an empty table.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), uniform(F.col(id_col)).alias("u"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), *([F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry else [])
    )
    rows = stable(base.drop("row"))
    goal = _small(stable(plan(rows, weights, share, most)))
    out = (base if carry else rows).withColumn("key", _key(F.col("source"))).join(goal, "key").withColumn("odds", _odds()).withColumn("place", _place())
    chosen = F.col("odds").isNotNull() & (F.col("edge").isNull() | (F.col("place") < F.col("edge")) | ((F.col("place") == F.col("edge")) & (F.struct("odds", "id", "size") <= F.col("last"))))
    return out.select("doc_id", "size", "source_size", "target", (F.col("whole") + F.coalesce(chosen, F.lit(False)).cast("long")).alias("copies"), *(["row"] if carry else []))


def mix(docs: DataFrame, **more) -> DataFrame:
    """``docs`` as the mixture takes them: each row as often as it is taken, with its own columns."""
    taken = mixture(docs, carry=True, **more).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
