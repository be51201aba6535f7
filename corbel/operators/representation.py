"""A record's fields in all their representations, under limits: as they are, normalized, decoded, and together."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs
from ..functions.jsonc import let
from . import detect
from .detect import Rule

# Limits of a record: fixed values.
MOST_FIELDS, MOST_BYTES, MOST_TOKENS = 32, 262_144, 64
_RUNS = ("  ", "\t", "\n", "\x0b", "\f", "\r")  # in a text of ASCII, what is white space but no single blank


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _settled(text: Column) -> Column:
    """A text without invisible characters, white space collapsed; long plain ones are told by looking for a few characters."""
    plain = lambda t: _ascii(t) & ~reduce(or_, [F.contains(t, F.lit(r)) for r in _RUNS])
    return let(text, lambda t: F.when(plain(t), F.trim(t)).otherwise(T.collapse_space(T.strip_invisible(t))))


def _listed(fields: Column, normal: Column, joined: Column) -> Column:
    """``items`` (kind, field ids, content) in order, and the number of base64 runs that decode to no text. ``normal`` has the NFKC forms of the fields, ``joined`` that of all together."""
    item = lambda kind, ids, content: F.struct(F.lit(kind).alias("kind"), ids.alias("ids"), content.alias("content"))
    tokens = lambda f: F.transform(detect.base64_runs(f["content"], MOST_TOKENS), detect.base64_text)

    def of(f: Column, i: Column, found: Column) -> Column:
        ids, plain = F.array(f["id"]), _settled(F.get(normal, i))
        decoded = F.transform(F.array_compact(found), lambda d: item("base64", ids, d))
        return F.concat(F.array(item("canonical", ids, f["content"])), F.filter(F.array(item("normalized", ids, plain)), lambda x: x["content"] != f["content"]), decoded)

    together = item("cross_field", F.transform(fields, lambda f: f["id"]), _settled(joined))
    each = lambda f, i: let(tokens(f), lambda found: F.struct(of(f, i, found).alias("items"), F.size(F.filter(found, lambda t: t.isNull())).alias("skipped")))
    rest = F.when(F.size(fields) > 0, F.array(together)).otherwise(F.array().cast("array<struct<kind:string,ids:array<string>,content:string>>"))
    sums = lambda parts: F.struct(F.concat(F.flatten(F.transform(parts, lambda p: p["items"])), rest).alias("items"), F.aggregate(parts, F.lit(0), lambda a, p: a + p["skipped"]).alias("skipped"))
    return let(F.transform(fields, each), sums)


def representations(records: DataFrame, id_col: str, fields_col: str) -> DataFrame:
    """``(id, outcome, n_bytes, skipped, items)`` of records with ``fields``, an array of ``(id, content)``.

    ``outcome`` is ok, too_many_fields, or too_many_bytes where all representations together pass the budget; only an ok record has items, in the order in which they are read. Null contents are empty. Records of
    ASCII alone need no Unicode forms: Python gets a null for them.
    """
    fields = F.transform(F.coalesce(F.col(fields_col), F.array()), lambda f: F.struct(f["id"].cast("string").alias("id"), F.coalesce(f["content"], F.lit("")).alias("content")))
    few, n = F.size("fields") <= MOST_FIELDS, F.size("fields")
    rows = records.select(F.col(id_col), fields.alias("fields")).withColumn("contents", F.when(few, F.transform("fields", lambda f: f["content"])))
    rows = rows.withColumn("contents", F.concat("contents", F.array(F.array_join("contents", " "))))
    odd = F.when(~F.forall("contents", _ascii), F.col("contents"))
    rows = rows.withColumn("odd", odd).withColumn("forms", udfs.nfkc_each(F.col("odd"))).withColumn("contents", F.coalesce("forms", "contents"))
    # all within the row and once: records are neither told apart by filters nor read again
    listed = rows.select(id_col, few.alias("few"), F.when(few, _listed(F.col("fields"), F.slice("contents", F.lit(1), n), F.get("contents", n))).alias("x")).select(id_col, "few", "x.*")
    size = F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + F.octet_length(i["content"]))
    listed = listed.withColumn("n_bytes", size).withColumn("outcome", F.when(~F.col("few"), "too_many_fields").when(F.col("n_bytes") > MOST_BYTES, "too_many_bytes").otherwise("ok"))
    ok = lambda c: F.when(F.col("outcome") == "ok", F.col(c)).alias(c)
    return listed.select(id_col, "outcome", "n_bytes", ok("skipped"), ok("items"))


def counts(rules: tuple[Rule, ...]) -> Column:
    """How often rules are found in the ``items`` of a record, by kind of representation: an array of ``(kind, rule_id, n)``, null where there are no items. A kind may occur more than once."""
    each = lambda i: F.transform(detect.counted(rules, i["content"]), lambda c: F.struct(i["kind"].alias("kind"), c["rule_id"].alias("rule_id"), c["n"].alias("n")))
    return F.flatten(F.transform("items", each))


def scan(listed: DataFrame, rules: tuple[Rule, ...], id_col: str) -> DataFrame:
    """Findings in the items of ``representations``: ``(id, place, kind, field_ids, rule_id, ..., start, end, lines and columns in the item's content)``."""
    each = listed.where("outcome = 'ok'").select(id_col, F.posexplode("items").alias("place", "item"))
    each = each.select(F.struct(id_col, "place", "item.kind", F.col("item.ids").alias("field_ids")).alias("of"), F.col("item.content").alias("content"))
    return detect.findings(each, rules, "of", "content").select("of.*", "*").drop("of")
