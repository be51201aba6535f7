"""Text expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as ECMAScript's \s has it: fixed values.
_SPACES = "\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
ECMA_SPACE = f"[{_SPACES}]+"
_NOT_A_BLANK = f"[{_SPACES}]{{2,}}|[{_SPACES}&&[^ ]]"  # runs other than one blank
ZERO_WIDTH = "[\\u200b-\\u200d\\ufeff]"
# Patterns of likely secrets: a private key block, an assignment to a credential's name, a live payment key. Fixed values.
SECRETS = (
    "-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "(?i)\\b(?:api[_ -]?key|access[_ -]?token|client[_ -]?secret|password|private[_ -]?key)\\s*[:=]\\s*[\"']?\\S{8,}",
    "\\b(?:sk|pk)_(?:live|prod)_[A-Za-z0-9_-]{12,}\\b",
)


def fold(text: Column) -> Column:
    return F.lower(text)


def occurrences(folded: Column, phrase: Column) -> Column:
    """Zero-based starts of all non-overlapping occurrences of a literal phrase, from the left."""
    literal = F.concat(F.lit("\\Q"), F.replace(phrase, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    group = 256  # pieces are added up group by group, as a fold copies what it holds at each step
    step = lambda acc, size: F.struct((acc["at"] + size).cast("int").alias("at"), F.array_append(acc["out"], (acc["at"] + size - F.char_length(phrase)).cast("int")).alias("out"))
    begin = lambda at, kind: F.struct(at.cast("int").alias("at"), F.array().cast(kind).alias("out"))

    def of(sizes: Column) -> Column:
        n = F.size(sizes) - 1
        within = lambda acc, k: F.aggregate(F.slice(sizes, k * group + 1, F.least(F.lit(group), n - k * group)), begin(acc["at"], "array<int>"), step)
        outer = lambda acc, k: F.element_at(F.transform(F.array(within(acc, k)), lambda g: F.struct(g["at"].alias("at"), F.array_append(acc["out"], g["out"]).alias("out"))), 1)
        groups = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / group).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.aggregate(groups, begin(F.lit(0), "array<array<int>>"), outer)["out"])

    # the text is cut once, and only the sizes of its pieces, each with the phrase behind it, go on
    sizes = F.transform(F.split(folded, literal, -1), lambda p: F.char_length(p) + F.char_length(phrase))
    return F.element_at(F.transform(F.array(sizes), of), 1)


def line(text: Column, offset: Column) -> Column:
    """1-based line of a zero-based offset."""
    prefix = F.substring(text, F.lit(1), offset)
    return (F.char_length(prefix) - F.char_length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1).cast("int")


def column(text: Column, offset: Column) -> Column:
    """1-based column of a zero-based offset."""
    return (F.char_length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1)) + 1).cast("int")


def source_span(runs: Column, start: Column, end: Column) -> Column:
    """Where a span of a canonical text stands in its source, by the runs of ``udfs.canonical_mapped``: exact within unchanged runs, the whole of a changed one that it touches. Null for an empty span."""
    met = F.filter(runs, lambda r: (r["canonical_start"] < end) & (r["canonical_end"] > start))
    first, last = F.get(met, 0), F.get(met, F.size(met) - 1)
    begin = F.when(first["same"], first["source_start"] + start - first["canonical_start"]).otherwise(first["source_start"])
    stop = F.when(last["same"], last["source_start"] + end - last["canonical_start"]).otherwise(last["source_end"])
    return F.when(F.size(met) > 0, F.struct(begin.cast("int").alias("start"), stop.cast("int").alias("end")))


def collapse_space(text: Column) -> Column:
    """ECMAScript white space collapsed to blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, _NOT_A_BLANK, " "))


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, ZERO_WIDTH, "")


def digest(value: Column) -> Column:
    """SHA-256 with its prefix."""
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def has_secret(text: Column) -> Column:
    out = F.lit(False)
    for pattern in SECRETS:
        out = out | text.rlike(pattern)
    return out


def host(url: Column) -> Column:
    """Lower-case host without user info and port."""
    authority = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))


def percent(bps: Column) -> Column:
    """Basis points as text."""
    return F.format_string("%.2f%%", bps / 100)


def slug(text: Column) -> Column:
    """Lower-case runs of letters and digits joined by dashes, 48 characters at most; ``udfs.unaccented`` makes plain letters of accented ones before."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, 48)


def private_ipv4(address: Column) -> Column:
    """Ranges that are not publicly routable (fixed values); null if the text is no dotted quad."""
    part = lambda k: F.regexp_extract(address, "^(\\d{1,3})\\.(\\d{1,3})\\.(\\d{1,3})\\.(\\d{1,3})$", k).try_cast("int")
    a, b = part(1), part(2)
    return (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 198) & b.isin(18, 19))
    )


def private_ipv6(address: Column) -> Column:
    low = F.lower(address)
    mapped = F.regexp_extract(low, "^::ffff:(\\d+\\.\\d+\\.\\d+\\.\\d+)$", 1)
    return low.isin("::", "::1") | low.rlike("^(?:fe[89ab]|f[cd])") | F.coalesce((mapped != "") & private_ipv4(mapped), F.lit(False))


def url_block_reason(url: Column) -> Column:
    """Why a URL may not be fetched, null if it may: https only, no user info, no port but 443, no private literal address."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(authority, "^.*@", "")
    port = F.regexp_extract(bare, ":([0-9]*)$", 1)
    name = F.regexp_replace(bare, ":[0-9]*$", "")
    literal6 = F.regexp_extract(name, "^\\[(.*)\\]$", 1)
    return (
        F.when(scheme == "", "INVALID_URL")
        .when(scheme != "https", "SCHEME_BLOCKED")
        .when(authority.contains("@"), "CREDENTIAL_URL_BLOCKED")
        .when((name == "") | ~port.isin("", "443"), "AUTHORITY_BLOCKED")
        .when((literal6 != "") & private_ipv6(literal6), "PRIVATE_ADDRESS_BLOCKED")
        .when(name.rlike("^(?:0[xX][0-9a-fA-F]+|[0-9]+)$"), "PRIVATE_ADDRESS_BLOCKED")
        .when(F.coalesce(private_ipv4(name), F.lit(False)), "PRIVATE_ADDRESS_BLOCKED")
    )


def content_type(value: Column) -> Column:
    """The type before parameters, in lower case; ``BLOCKED`` unless it may be parsed, null if empty."""
    kind = F.lower(F.trim(F.substring_index(value, ";", 1)))
    # fixed values
    allowed = ("application/json", "application/pdf", "application/xml", "text/html", "text/plain", "text/xml")
    return F.when(value.isNull(), "BLOCKED").when(kind == "", F.lit(None)).when(kind.isin(*allowed), kind).otherwise("BLOCKED")


def decoded(raw: Column, charset: Column) -> Column:
    """Text of bytes in UTF-8, UTF-16LE or UTF-16BE (fixed values); null for another charset or bytes that do not come back the same."""
    out = F.when(charset == "utf-8", F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")))
    for name in ("UTF-16LE", "UTF-16BE"):
        even = F.octet_length(raw) % 2 == 0
        text = F.decode(F.when(even, raw).otherwise(F.lit(b"")), name)
        out = out.when((charset == name.lower()) & even & ~F.contains(text, F.lit("\ufffd")), text)
    return out
