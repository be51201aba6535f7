"""Canonical JSON without Python: one text for equal values, so that digests agree.

Keys stand in UTF-16 order (a parsed variant keeps them so) or in the order of English collation, numbers in the shortest form that gives the same double, strings with short escapes
and lower-case ``\\u00xx``; there is no white space. What is no JSON, repeats a key in an object, or holds a number beyond a double is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CONTROLS = [f"\\u{k:04X}" for k in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20))]  # escapes whose digits have letters
_SLASH, _QUOTE, _BEYOND = "\x01", "\x02", "\x03"  # stand-ins inside a text: JSON never has these characters raw
LEVELS = 12
# Which order of keys each use of canonical JSON has: fixed values.
FORMS = {"signing": "locale", "rules": "locale", "ingestion": "utf16", "provenance": "utf16", "webhooks": "utf16"}


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once. Nested ones cost the analyzer a pass each."""
    return F.get(F.transform(F.array(value), body), 0)


def _shortest(d: Column) -> Column:
    """A positive double as Java writes it, or with fewer digits if these give the same double."""
    plain = d.cast("string")
    digits = F.char_length(F.regexp_replace(plain, "E.*|[.]|^0[.]0*", ""))
    tried = lambda ps: F.coalesce(F.get(F.filter(F.array(*(F.format_string(f"%.{p}e", d) for p in ps)), lambda t: t.cast("double") == d), 0), plain)
    # of 16 to 18 digits one or two may be too many; what is next to nothing has fewer than Java's two
    return F.upper(F.when(d < 1e-300, tried(range(17))).when(digits > 15, tried((14, 15, 16))).otherwise(plain))


def number(token: Column) -> Column:
    """A JSON number in its shortest form: plain from 1e-6 to below 1e21, else with an exponent; null beyond a double."""
    d = token.try_cast("double")
    short = let(F.abs(d), lambda a: F.when(a < float("inf"), let(let(_shortest(a), _digits), _laid_out)))
    full = F.when(d == 0, "0").when(d < 0, F.concat(F.lit("-"), short)).otherwise(short)
    cut = F.regexp_replace(token, "[.]?0*$", "")
    # up to 15 digits in reach of a double are the shortest that give it: only their layout changes
    moved = F.concat(F.when(F.startswith(token, F.lit("-")), "-").otherwise(""), let(_digits(F.upper(F.ltrim(token, F.lit("-")))), _laid_out))
    # up to 15 digits without an exponent are as they should be, but for zeros at the end of a fraction
    return F.when(token.rlike("^(0|-?[1-9][0-9]{0,14})$"), token).when(token.rlike("^-?(?:0[.]0{0,5}[1-9]|[1-9][0-9]*[.])[0-9]*$") & (F.char_length(token) <= 16), cut).when(token.rlike("^-?(?=[0-9.]{1,16}[eE])[0-9]*[.]?0*[1-9][0-9]*[eE][-+]?[0-9]{1,2}$|^-?(?=[0-9.]{1,16}[eE])0*[1-9][0-9]*[.][0-9]*[eE][-+]?[0-9]{1,2}$"), moved).otherwise(full)


def _digits(s: Column) -> Column:
    """What Java wrote as digits ``d`` without zeros at the ends, and how many stand before the point, ``n``."""
    mantissa = F.substring_index(s, "E", 1)
    every = F.replace(mantissa, F.lit("."), F.lit(""))
    bare = F.ltrim(every, F.lit("0"))
    whole = F.char_length(F.substring_index(mantissa, ".", 1)) + F.coalesce(F.regexp_extract(s, "E[+]?(-?[0-9]+)", 1).try_cast("int"), F.lit(0))
    return F.struct(F.rtrim(bare, F.lit("0")).alias("d"), (whole - F.char_length(every) + F.char_length(bare)).alias("n"))


def _laid_out(x: Column) -> Column:
    d, n = x["d"], x["n"]
    k = F.char_length(d)
    exponent = F.concat(F.when(n > 0, "e+").otherwise("e-"), F.abs(n - 1).cast("string"))
    return (
        F.when((k <= n) & (n <= 21), F.rpad(d, n, "0"))
        .when((n > 0) & (n <= 21), F.concat(F.substring(d, F.lit(1), n), F.lit("."), F.substring(d, n + 1, k)))
        .when((n > -6) & (n <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -n), d))
        .when(k == 1, F.concat(d, exponent))
        .otherwise(F.concat(F.substring(d, 1, 1), F.lit("."), F.substring(d, F.lit(2), k), exponent))
    )


def _strings(text: Column) -> Column:
    """Escapes of control characters with lower-case digits."""
    out = text
    for c in _CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c.lower()))
    return F.when(F.contains(text, F.lit("\\u00")), out).otherwise(text)


def normalized(compact: Column) -> Column:
    """Compact JSON with its numbers and escapes in canonical form. Strings are told from the rest by their quotes, once escaped backslashes and quotes have stand-ins."""
    parts = F.split(F.replace(F.replace(compact, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE)), '"')
    tokens = lambda s: F.regexp_extract_all(s, F.lit("[-0-9][-+.0-9eE]*|[^-0-9]+"), F.lit(0))
    fixed = lambda s: F.array_join(F.transform(tokens(s), lambda t: F.when(t.rlike("^[-0-9]"), F.coalesce(number(t), F.lit(_BEYOND))).otherwise(t)), "")
    joined = F.array_join(F.transform(parts, lambda s, i: F.when(i % 2 == 1, _strings(s)).when(s.rlike("[0-9]"), fixed(s)).otherwise(s)), '"')
    whole = let(joined, lambda j: F.when(~F.contains(j, F.lit(_BEYOND)), j))
    return F.replace(F.replace(whole, F.lit(_QUOTE), F.lit('\\"')), F.lit(_SLASH), F.lit("\\\\"))


def canonical_variant(value: Column) -> Column:
    """The canonical text of a variant, keys in UTF-16 order."""
    return normalized(F.to_json(value))


def _by_locale(v: Column, levels: int) -> Column:
    """The text of a variant with keys in English order, level by level."""
    entries, items = F.try_variant_get(v, "$", "map<string,variant>"), F.try_variant_get(v, "$", "array<variant>")
    if levels == 0:
        return F.when(entries.isNotNull() | items.isNotNull(), F.raise_error(F.lit("canonical JSON: too many levels"))).otherwise(F.to_json(v))
    order = lambda a, b: F.when(F.collate(a["key"], "en") < F.collate(b["key"], "en"), -1).when(F.collate(a["key"], "en") > F.collate(b["key"], "en"), 1).otherwise(0)
    name = lambda key: F.when(key.isNotNull(), F.concat(F.regexp_extract(F.to_json(F.struct(key.alias("k"))), r'(?s)^\{"k":(.*)\}$', 1), F.lit(":"))).otherwise("")

    def of(m: Column) -> Column:
        """Of the map that an object is, null for other values."""
        each = F.when(m.isNotNull(), F.array_sort(F.map_entries(m), order)).otherwise(F.transform(items, lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value"))))
        texts = F.array_join(F.transform(each, lambda e: F.concat(name(e["key"]), _by_locale(e["value"], levels - 1))), ",")
        end = lambda object_, array: F.when(m.isNotNull(), object_).otherwise(array)
        return F.coalesce(F.concat(end("{", "["), texts, end("}", "]")), F.to_json(v))

    return let(entries, of)


def canonical(value: Column, order: str = "utf16", levels: int = LEVELS, parsed: Column | None = None) -> Column:
    """The canonical text of a JSON text. ``order`` of keys: ``utf16``, or ``locale`` for English collation, up to ``levels`` nested levels (more raise an error). ``parsed``: its variant, if it is there already."""
    if order not in ("utf16", "locale"):
        raise ValueError(order)
    if parsed is None:
        return let(F.try_parse_json(value), lambda v: canonical(value, order, levels, v))
    # a variant makes a number beyond a double infinite, and then a string; what looks like one stands after a sign of JSON, unlike the digits of digests
    beyond = lambda c: F.contains(c, F.lit("Infinity")) & value.rlike("(?:^|[\\[:,\\s])-?[0-9.]*?(?:[0-9][eE][+]?[0-9]{3}|[0-9]{300})") & normalized(value).isNull()
    text = F.to_json(parsed) if order == "utf16" else F.when(parsed.isNotNull(), _by_locale(parsed, levels))
    return let(text, lambda c: F.when(~F.coalesce(beyond(c), F.lit(False)), normalized(c)))


def digest(text: Column) -> Column:
    """``sha256:`` and the hex digest of a text's UTF-8 bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))
