"""Account assets, instrument catalogues and watchlists as they arrive: identifiers, exact quantities, kinds, and what makes a response invalid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonc
from ..functions.jsonc import let

MOST_WATCHED = 500
# What codes of a provider's responses mean: fixed values.
RETRYABLE_CODES = ("429", "25000", "25001", "25003", "25004", "40015", "40725", "40808", "45001")
REVOKED_CODES = ("40001", "40002", "40003", "40006", "40009")
DENIED_CODES = ("40301", "40752", "40753")
NUMERIC = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")


def identifier(value: Column) -> Column:
    """Trimmed upper-case name of 1 to 64 allowed characters; null if it is none."""
    name = F.upper(F.trim(value))
    return F.when(name.rlike("^[A-Z0-9$._-]{1,64}$"), name)


def decimal_text(value: Column, negative: bool = False) -> Column:
    """A plain decimal of up to 100 digits as text, or null."""
    t = F.trim(value)
    fits = (F.char_length(t) <= 100) | (F.char_length(F.regexp_replace(t, "[.-]", "")) <= 100)
    return F.when(t.rlike(("^-?" if negative else "^") + "\\d+(?:\\.\\d+)?$") & fits, t)


def _short_total(parts: Column) -> Column:
    """``decimal_total`` of at most 9 decimals of at most 17 characters: a sum below 10^18 with at most 16 digits behind the point."""
    kind, most = "decimal(35,16)", 18
    total = F.aggregate(parts, F.lit(10**most).cast(kind), lambda acc, p: (acc + p.cast(kind)).cast(kind)).cast("string")  # 10^18 more, so that all digits are there

    def placed(t: Column) -> Column:
        whole = F.substring(t, 2, most).cast("long").cast("string")
        return let(F.rtrim(F.substring(t, most + 3, 16), F.lit("0")), lambda rest: F.when(rest == "", whole).otherwise(F.concat(whole, F.lit("."), rest)))

    return let(total, placed)


def decimal_total(parts: Column) -> Column:
    """The exact sum of an array of decimals without sign, of any number of digits, without zeros at its end; null of an empty array.

    A few short ones are added as they are. Else digits are aligned and added in pieces of 18 from the right, with what is carried.
    """
    size = 18
    part = lambda p, n: F.when(F.contains(p, F.lit(".")), F.substring_index(p, ".", n)).otherwise(p if n == 1 else F.lit(""))
    longest = lambda n: F.array_max(F.transform(parts, lambda p: F.char_length(part(p, n))))
    scale = longest(-1)
    pieces = F.ceil((longest(1) + scale) / size).cast("int")
    aligned = F.transform(parts, lambda p: F.lpad(F.concat(part(p, 1), F.rpad(part(p, -1), scale, "0")), pieces * size, "0"))
    here = lambda all_, i: F.aggregate(all_, F.lit(0).cast("long"), lambda acc, p: acc + F.substring(p, i * size + 1, F.lit(size)).cast("long"))

    def step(acc: Column, i: Column) -> Column:
        return let(F.struct((here(acc["all"], i) + acc["carry"]).alias("sum"), acc["text"].alias("text"), acc["all"].alias("all")), lambda x: F.struct(F.concat(F.lpad((x["sum"] % 10**size).cast("string"), size, "0"), x["text"]).alias("text"), F.floor(x["sum"] / F.lit(10**size).cast("decimal(20,0)")).cast("long").alias("carry"), x["all"].alias("all")))

    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("carry"), aligned.alias("all"))
    whole = F.aggregate(F.reverse(F.sequence(F.lit(0), pieces - 1)), start, step, lambda acc: F.concat(acc["carry"].cast("string"), acc["text"]))
    placed = let(whole, lambda t: F.when(scale > 0, F.concat(F.substring(t, F.lit(1), F.char_length(t) - scale), F.lit("."), F.rtrim(F.right(t, scale), F.lit("0")))).otherwise(t))
    short = (F.size(parts) <= 9) & F.forall(parts, lambda p: F.char_length(p) <= 17)
    return F.when(F.size(parts) > 0, F.when(short, _short_total(parts)).otherwise(F.regexp_replace(F.regexp_replace(placed, "^0+(?=[0-9])", ""), "[.]$", "")))


def holdings(rows: DataFrame, account: str = "account_id") -> DataFrame:
    """``(account, asset, quantity, error)`` of ``rows(account, coin, balance, available, frozen, locked)``: the balance as it is given, or the exact sum of its parts.

    An account whose response has an asset twice, a bad name or no quantity is invalid as a whole and gives one row with the error; quantities not above zero, by their digits and sign, are
    left out. Decimals have up to 100 digits, sums as many as they need; other texts are none. Rows are dealt by account once, before any work on them; an account's rows
    pass through one task in the order of their assets, beside the disk where they are many.
    """
    rows = rows.repartition(account)
    parts = F.array_compact(F.array(*(decimal_text(F.col(c)) for c in ("available", "frozen", "locked"))))
    named = rows.select(account, identifier(F.col("coin")).alias("asset"), decimal_text(F.col("balance"), True).alias("balance"), parts.alias("parts"))
    named = named.select(account, "asset", F.coalesce("balance", decimal_total(F.col("parts"))).alias("q"))
    whole = Window.partitionBy(account)
    in_order = whole.orderBy("asset")
    marked = named.select(account, "asset", "q", (F.lag("asset").over(in_order) == F.col("asset")).alias("again"), F.row_number().over(in_order).alias("place"))
    any_ = lambda c: F.coalesce(F.bool_or(c).over(whole), F.lit(False))
    error = F.when(any_(F.col("asset").isNull()), "INVALID_IDENTIFIER").when(any_(F.col("again")), "DUPLICATE_ASSET").when(any_(F.col("q").isNull()), "INVALID_BALANCE")
    above = ~F.col("q").startswith("-") & F.col("q").rlike("[1-9]")
    good = F.col("error").isNull()
    out = marked.withColumn("error", error).where((good & above) | (~good & (F.col("place") == 1)))
    return out.select(account, F.when(good, F.col("asset")).alias("asset"), F.when(good, F.col("q")).alias("quantity"), "error")


def responses(rows: DataFrame, status: str = "status", body: str = "body") -> DataFrame:
    """``rows`` with ``code``, ``error`` and ``request_time`` of each response: the status ladder, then the time.

    ``error`` is null for a good response. A code is a string or a number at ``$.code``; the time is a number or a string of one, whole, above zero and within 8.64e15 milliseconds.
    """
    v, state = F.try_parse_json(body), F.col(status)
    at = lambda p: F.try_variant_get(v, p, "variant")
    is_object = F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    kind = lambda p: F.coalesce(F.regexp_extract(F.schema_of_variant(at(p)), "^[A-Z]+", 0), F.lit(""))
    code = F.when(is_object & (kind("$.code") == "STRING"), F.try_variant_get(v, "$.code", "string")).when(is_object & kind("$.code").isin(*NUMERIC), jsonc.canonical_variant(at("$.code")))
    has = lambda names: F.coalesce(F.col("code").isin(*names), F.lit(False))
    text = F.trim(F.try_variant_get(v, "$.requestTime", "string"))
    time = F.when(kind("$.requestTime").isin(*NUMERIC), F.try_variant_get(v, "$.requestTime", "double")).when((kind("$.requestTime") == "STRING") & text.rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    out = rows.withColumn("code", code).withColumn("_time", time)
    good_time = (F.col("_time") > 0) & (F.col("_time") == F.floor("_time")) & (F.col("_time") <= 8.64e15)
    error = (
        F.when((state == 401) | has(REVOKED_CODES), "CREDENTIAL_REVOKED").when((state == 403) | has(DENIED_CODES), "PERMISSION_DENIED").when((state == 429) | has(("429",)), "RATE_LIMITED")
        .when((state >= 500) | has(RETRYABLE_CODES), "UNAVAILABLE").when(state.isNull() | (state < 200) | (state >= 300) | ~F.coalesce(is_object, F.lit(False)) | ~has(("00000",)), "RESPONSE_INVALID").when(~F.coalesce(good_time, F.lit(False)), "TIME_INVALID")
    )
    stamp = F.date_format(F.timestamp_millis(F.col("_time").cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return out.withColumn("error", error).withColumn("request_time", F.when(F.col("error").isNull(), stamp)).drop("_time")


def account_assets(rows: DataFrame, account: str = "account_id", body: str = "body") -> DataFrame:
    """``(account, coin, balance, available, frozen, locked)`` of the assets in good responses, for ``holdings``.

    ``$.data`` is a list of assets (each an object with a ``coin``), a list of accounts or one account with ``assets`` of their own; what has another shape has none. Values are taken from strings
    only: of a number, a flag or an object the text is null. What isn't an object in a list of nested assets is skipped.
    """
    data = F.try_variant_get(F.try_parse_json(body), "$.data", "variant")
    lists = lambda v: F.try_variant_get(v, "$", "array<variant>")
    objects = lambda xs: F.filter(xs, lambda x: F.try_variant_get(x, "$", "map<string,variant>").isNotNull())
    nested = lambda v: F.coalesce(objects(F.try_variant_get(v, "$.assets", "array<variant>")), F.array().cast("array<variant>"))
    flat = F.forall(lists(data), lambda x: F.map_contains_key(F.try_variant_get(x, "$", "map<string,variant>"), "coin"))
    found = F.when(lists(data).isNull(), nested(data)).when(F.coalesce(flat, F.lit(False)), lists(data)).otherwise(F.flatten(F.transform(lists(data), nested)))
    each = rows.select(account, F.explode(found).alias("asset"))
    text = lambda name: F.when(F.schema_of_variant(F.try_variant_get("asset", f"$.{name}", "variant")) == "STRING", F.try_variant_get("asset", f"$.{name}", "string")).alias(name)
    return each.select(account, *(text(n) for n in ("coin", "balance", "available", "frozen", "locked")))


def kind(base: Column, reality: Column, symbol_type: Column) -> Column:
    """rtoken, crypto or other."""
    t = F.lower(F.coalesce(symbol_type, F.lit("")))
    return F.when((F.lower(F.coalesce(reality, F.lit(""))) == "yes") | ((t == "stock") & base.rlike("^R[A-Z]")), "rtoken").when(t.isin("crypto", ""), "crypto").otherwise("other")


def instruments(rows: DataFrame) -> DataFrame:
    """``(symbol, base, quote, kind, status, underlying, duplicate)`` of ``rows(symbol, base_coin, quote_coin, is_reality, symbol_type, status)``; bad names are null, a symbol that occurs again is marked."""
    named = rows.select(identifier(F.col("symbol")).alias("symbol"), identifier(F.col("base_coin")).alias("base"), identifier(F.col("quote_coin")).alias("quote"), "is_reality", "symbol_type", F.lower("status").alias("s"))
    named = named.withColumn("kind", kind(F.col("base"), F.col("is_reality"), F.col("symbol_type"))).withColumn("status", F.when(F.col("s").isin("online", "offline"), F.col("s")).otherwise("unknown"))
    under = F.when((F.col("kind") == "rtoken") & F.col("base").rlike("^R[A-Z0-9$._-]+$"), F.expr("substring(base, 2)"))
    twice = named.groupBy("symbol").agg(F.count("*").alias("n"))
    return named.withColumn("underlying", under).join(twice, "symbol", "left").select("symbol", "base", "quote", "kind", "status", "underlying", F.coalesce(F.col("n") > 1, F.lit(False)).alias("duplicate"))


def watchlist(rows: DataFrame, owner: str) -> DataFrame:
    """Each owner's distinct valid instruments in order, with ``place``; an owner with over 500 entries, or a bad name, gets one row with the error."""
    named = rows.select(owner, identifier(F.col("instrument")).alias("instrument"))
    per = named.groupBy(owner, "instrument").agg(F.count("*").alias("n"))
    error = F.when(F.sum("n") > MOST_WATCHED, "TOO_MANY").when(F.bool_or(F.col("instrument").isNull()), "INVALID_IDENTIFIER")
    broken = per.groupBy(owner).agg(error.alias("error")).where("error is not null")
    good = per.join(broken, owner, "left_anti").withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy("instrument")))  # 500 rows an owner at most
    bad = broken.select(owner, F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("instrument"), "error")
    return good.select(owner, "place", "instrument", F.lit(None).cast("string").alias("error")).unionByName(bad)
