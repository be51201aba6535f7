"""Importance resampling to a target distribution over hashed n-grams; DataFrame functions only.

Words are posexploded to a table of positions. For orders above 1 a window per document leads the following words to each position, so that a row
holds the n-grams that begin there. Features are hashed to buckets and counted; a bucket's gain is the scaled log of its smoothed share in the target over its
share in the corpus. Gains, one row a bucket, are sent to all tasks and joined to the positions again; a document's weight is their mean. Weights and
noise from the id give a score, and the highest scores are drawn: Gumbel noise on log weights draws without replacement in proportion to the weights.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stable

BUCKETS = 10_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UNIT = 1000  # gains, weights and scores are integers in thousandths of a nat


def positions(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, copies, pos, word)`` of ``docs(doc_id, text, copies)``: one row a word. A separator at a text's ends gives an empty word, and a text without
    words one at place 0, so each row of ``docs`` has exactly one row at place 0."""
    lower = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    cut = docs.select("doc_id", digest.alias("digest"), "copies", F.split(lower, SEPARATORS).alias("words"))  # before the rows multiply; the outer form, as there always is a word, asks for no filter on the split
    return cut.select("doc_id", "digest", "copies", F.posexplode_outer("words").alias("pos", "word"))


def features(docs: DataFrame, orders: int, buckets: int) -> DataFrame:
    """``(doc_id, digest, copies, head, word, bucket)`` of the positions: a row for each n-gram of 1 to ``orders`` words, its bucket null where none begins; ``head`` marks
    one row of each row of ``docs``, ``word`` the rows of order 1 with a word.

    Order 1 needs no neighbours and no shuffle. For more, rows that are repeated whole become one with their number in ``copies`` first, so a window's key names one text.
    """
    if orders > 1:
        docs = docs.groupBy("doc_id", F.coalesce("text", F.lit("")).alias("text")).agg(F.sum("copies").alias("copies"))
    at = positions(docs)
    bucket = lambda gram: F.crc32(gram.cast("binary")) % buckets
    word = F.col("word") != ""
    if orders == 1:
        return at.select("doc_id", "digest", "copies", (F.col("pos") == 0).alias("head"), word.alias("word"), F.when(word, bucket(F.col("word"))).alias("bucket"))
    place = Window.partitionBy("doc_id", "digest").orderBy("pos")
    at = at.select("*", *(F.lead("word", k).over(place).alias(f"next{k}") for k in range(1, orders)))
    grams, whole, text = [], word, F.col("word")
    for k in range(orders):
        if k:
            whole, text = whole & F.coalesce(F.col(f"next{k}") != "", F.lit(False)), F.concat_ws(" ", text, f"next{k}")
        grams.append(F.struct(((F.col("pos") == 0) & F.lit(k == 0)).alias("head"), (whole & F.lit(k == 0)).alias("word"), F.when(whole, bucket(text)).alias("bucket")))
    return at.select("doc_id", "digest", "copies", F.inline(F.array(*grams))).where("head or bucket is not null")


def _rows(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return table.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.lit(1).cast("long").alias("copies"))


def gains(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """``(bucket, gain)``, a row for each bucket: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), s and t the bucket's features in ``docs`` and ``target``, S and T all.

    Counts are added up before they are shuffled: a task sends a row a bucket at most. Without features on either side gains are those of empty counts.
    """
    counts = []
    for rows, name in ((_rows(docs, id_col, text_col), "s"), (_rows(target, target_id, target_text), "t")):
        found = features(rows, orders, buckets).where("bucket is not null")
        counts.append(stable(found.groupBy("bucket").agg(F.sum("copies").alias(name))))
    big_s, big_t = (c.agg(F.sum(c.columns[1])).first()[0] or 0 for c in counts)
    every = docs.sparkSession.range(buckets).toDF("bucket").join(F.broadcast(counts[0]), "bucket", "left").join(F.broadcast(counts[1]), "bucket", "left")
    one = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double") + 1
    ratio = (one("t") * F.lit(float(big_s + buckets))) / (one("s") * F.lit(float(big_t + buckets)))
    return every.select("bucket", F.floor(F.lit(float(UNIT)) * F.ln(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the sha256 of the seed and the id; reruns agree. A null id counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(UNIT)) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = BUCKETS, min_words: int = 20, percent: int = 10, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """Every row's ``(doc_id, n_features, weight, score, rank)``; ``rank`` from 1 by falling score, ties to smaller ids, for the ``percent`` of rows of ``min_words`` words that are drawn, else null.

    Null and empty texts have no features and weight 0. Null ids come last among ties; under equal ids and scores texts are ordered by their digest, and rows repeated whole take ranks one after the other.
    Very long texts become rows of words like any other. Other columns may have any name. An empty table gives an empty one; an empty target leaves weights to the corpus counts alone.
    A rank is the number of rows with higher scores, by a histogram of scores, plus the place within one score: scores are integers in thousandths, and noise spreads different ids so that a score has at most about one in 2,700 of them.
    """
    table = gains(docs, target, orders, buckets, id_col, text_col, target_id, target_text)
    at = features(_rows(docs, id_col, text_col), orders, buckets).join(F.broadcast(stable(table)), "bucket", "left")  # a row a bucket, so bounded by the parameter
    heads = F.count_if("head")
    each = at.groupBy("doc_id", "digest").agg(F.count("bucket").alias("n"), F.count_if("word").alias("words"), F.sum("gain").alias("gain"), heads.alias("heads"), F.sum(F.when(F.col("head"), F.col("copies"))).alias("copies"))
    # rows repeated whole were counted together: each has an equal share
    n, words, gain = (F.expr(f"{c} div heads") for c in ("n", "words", "coalesce(gain, 0L)"))
    each = each.select("doc_id", "digest", "copies", n.alias("n_features"), words.alias("words"), gain.alias("gain"))
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    each = stable(each.withColumn("weight", weight).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    fit = each.where(F.col("words") >= min_words)
    draw = (fit.agg(F.sum("copies")).first()[0] or 0) * percent // 100
    above = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)  # over one row a score
    levels = fit.groupBy("score").agg(F.sum("copies").alias("here")).select("score", F.coalesce(F.sum("here").over(above), F.lit(0)).alias("before")).where(F.col("before") < draw)
    marked = each.join(F.broadcast(stable(levels)), "score", "left").withColumn("before", F.when(F.col("words") >= min_words, F.col("before")))
    place = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = marked.where("before is not null").withColumn("upto", F.col("before") + F.sum("copies").over(place))
    rest = marked.where("before is null").withColumn("upto", F.lit(None).cast("long"))
    copies = drawn.unionByName(rest).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    rank = F.col("upto") - F.col("copies") + F.col("copy")
    return copies.select("doc_id", "n_features", "weight", "score", F.when(rank <= draw, rank).alias("rank"))
