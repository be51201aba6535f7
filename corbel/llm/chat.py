r"""Chat formatting from event logs; DataFrame functions only.

A log holds events of conversations in sequence: ``message`` begins a message with a role and perhaps text, ``delta`` adds text, ``edit`` replaces the text so far,
``regenerate`` voids it, and with it every message that began after that one and before the event. The log is folded by message; a message's later
fate is a running maximum along its conversation, formed in runs of consecutive messages whose results are carried over, so that a long conversation takes many
tasks. Messages are rendered in blocks of 64, rows of ``(conv_id, part, block, formatted, mask)``: the blocks of a conversation in order are its text.

The template is ``<turn:ROLE>\nTEXT\n</turn>\n``. In texts a backslash is put behind the ``<`` of every ``<turn``, ``</turn`` and of what already has backslashes there, so
that one backslash taken away gives the text back, and nothing else is touched. In roles, after that, ``\`` becomes ``\b`` and ``>`` becomes ``\g``. The mask lists the texts to learn from as start and length in
code points of their block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stable

OPEN, CLOSE, LEARN = "<turn:", "\n</turn>\n", "assistant"
STARTS, RESETS = ("message",), ("message", "edit", "regenerate")
BLOCK = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", "<$1$2")


def _role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\b")), F.lit(">"), F.lit("\\g"))


def _unrole(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\")))


def fold(log: DataFrame) -> DataFrame:
    """``(conv_id, start, role, text, until)`` a message of ``log(conv_id, seq, kind, message, role, text)``: its text after its last reset, and the last event that regenerated it.

    ``seq`` is any type with an order. An event that is repeated whole counts once, as logs may be delivered twice. Events of a message that no ``message`` event begins, null sequences and
    unknown kinds count for nothing; null roles and texts are empty. Of two ``message`` events the first gives role and place, the later one's text counts.
    """
    of = lambda *kinds: lambda e: e["kind"].isin(*kinds)
    known = log.where(F.col("seq").isNotNull() & F.col("kind").isin(*RESETS, "delta"))
    event = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    each = known.groupBy("conv_id", "message").agg(F.array_sort(F.collect_set(event)).alias("events"))
    begun = F.get(F.filter("events", of(*STARTS)), 0)
    last = F.array_max(F.transform(F.filter("events", of(*RESETS)), lambda e: e["seq"]))
    each = each.select("conv_id", "events", begun.alias("begun"), last.alias("last")).where("begun is not null")
    text = F.array_join(F.transform(F.filter("events", lambda e: e["seq"] >= F.col("last")), lambda e: e["text"]), "")
    until = F.array_max(F.transform(F.filter("events", of("regenerate")), lambda e: e["seq"]))
    return each.select("conv_id", F.col("begun.seq").alias("start"), F.col("begun.role").alias("role"), text.alias("text"), until.alias("until"))


def messages(log: DataFrame) -> DataFrame:
    """``(conv_id, part, n, start, role, text)``: the messages that remain, numbered from 0 within the parts into which conversations were cut along their sequence."""
    cut = stable(fold(log).repartitionByRange(F.col("conv_id"), F.col("start"), "role", "text").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a part
    carried = cut.groupBy("conv_id", "part").agg(F.max("until").alias("until")).select(F.col("conv_id").alias("of"), F.col("part").alias("at"), F.max("until").over(before).alias("carry")).where("carry is not null")
    rows = cut.join(_small(stable(carried)), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")), "left")
    place = Window.partitionBy("conv_id", "part").orderBy("start", "role", "text")
    own = F.max("until").over(place.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("void_until", F.greatest("carry", own)).where("void_until is null or void_until <= start")
    return rows.withColumn("n", F.row_number().over(place) - 1).select("conv_id", "part", "n", "start", "role", "text")


def _small(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Stable rows for a join: sent to all tasks up to ``most``, else shuffled."""
    return F.broadcast(rows) if rows.count() <= most else rows


def render(log: DataFrame, learn: tuple[str, ...] = (LEARN,)) -> DataFrame:
    """``(conv_id, part, block, formatted, mask)`` of a log: up to 64 messages a row; null conversation ids are one conversation."""
    head = F.concat(F.lit(OPEN), _role(F.col("role")), F.lit(">\n"))
    body = escape(F.col("text"))
    turn = F.struct("n", F.concat(head, body, F.lit(CLOSE)).alias("all"), F.when(F.col("role").isin(*learn), F.char_length(head)).alias("skip"), F.char_length(body).alias("length"))
    blocks = messages(log).groupBy("conv_id", "part", F.floor(F.col("n") / BLOCK).cast("int").alias("block")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # where each turn begins: turns up to and with it, less itself
    step = lambda acc, t: F.struct((acc["at"] + F.char_length(t["all"])).alias("at"), F.when(t["skip"].isNull(), acc["mask"]).otherwise(F.array_append(acc["mask"], F.struct((acc["at"] + t["skip"]).alias("start"), t["length"].alias("length")))).alias("mask"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))
    return blocks.select("conv_id", "part", "block", F.array_join(F.transform("turns", lambda t: t["all"]), "").alias("formatted"), F.aggregate("turns", none, step)["mask"].alias("mask"))


def parse(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns``, an array of ``(role, text)`` read back from it, and ``learned``, what stands under the mask."""
    pieces = F.split("formatted", CLOSE)
    turn = lambda p: F.struct(_unrole(F.substring(F.substring_index(p, ">", 1), len(OPEN) + 1, 1 << 30)).alias("role"), unescape(F.substring(p, F.char_length(F.substring_index(p, ">", 1)) + 3, F.lit((1 << 31) - 1))).alias("text"))
    learned = F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["length"])))
    return formatted.select("*", F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn).alias("turns"), learned.alias("learned"))


def summary(formatted: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` read back from rendered blocks.

    A digest needs all of a conversation at once, so its blocks meet in one row, each already one text: a conversation must fit a row (2 GB).
    """
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    blocks = parse(formatted).select("conv_id", F.size("turns").alias("n"), F.char_length("formatted").alias("chars"), F.struct("part", "block", said.alias("said"), F.array_join("learned", "").alias("learned")).alias("piece"))
    whole = blocks.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("piece")).alias("pieces"))
    text = lambda c: F.array_join(F.transform("pieces", lambda p: p[c]), "")
    digest = lambda c: F.sha2(text(c).cast("binary"), 256)
    return whole.select("conv_id", "n_turns", digest("said").alias("turns_sha256"), F.char_length(text("learned")).cast("long").alias("loss_chars"), digest("learned").alias("loss_sha256"), "formatted_chars")


def events(rows: DataFrame, size: int = 2048) -> DataFrame:
    """The log of ``rows(conv_id, turn, role, text)``: each row a message that is streamed in deltas of ``size`` code points.

    Rows go by turn, then role and text; null turns come first. Rows that are repeated whole are messages of their own, numbered by ``copy``.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("times")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    message = F.struct("turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "copy")
    pieces = F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
    rows = rows.select("conv_id", "role", message.alias("message"), pieces.alias("pieces")).select("conv_id", "role", "message", F.posexplode_outer("pieces").alias("k", "piece"))
    return rows.select("conv_id", F.struct("message.*", "k").alias("seq"), F.when(F.col("k") == 0, "message").otherwise("delta").alias("kind"), "message", F.when(F.col("k") == 0, F.col("role")).alias("role"), F.col("piece").alias("text"))
