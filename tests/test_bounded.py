"""Work that stays bounded whatever a batch, a key or a group holds."""

import json

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corbel.functions import text as T
from corbel.functions import udfs
from corbel.operators import detect, portfolio


@pytest.mark.parametrize("run", ["_parse", "_canonicalize", "canonical_content", "canonical_mapped", "nfkc"])
def test_results_of_a_batch_come_in_parts(run):
    texts = ["<a href=x>é</a>" * 5_000] * 40
    parts = [len(p) for p in getattr(udfs, run).func(iter([pa.array(texts)]))]
    assert sum(parts) == 40 and max(parts) <= 4


def test_all_links_of_a_page_are_listed(spark):
    page = "".join(f"<a href=/{k}>n{k}</a>" for k in range(2_500)) + "<p hidden>" + "<a href=/no>no</a>" * 3
    assert udfs.parse_page(page)[3] == [{"href": f"/{k}", "text": f"n{k}"} for k in range(2_500)]
    got = spark.createDataFrame([(page,)], "t string").select(F.explode(udfs.parse_html(F.col("t"))["links"]).alias("l")).select("l.*").collect()
    assert len(got) == 2_500 and tuple(got[-1]) == ("/2499", "n2499")


def test_a_page_is_read_to_its_end():
    words = "word " * 300_000 + "end"
    for page in (words, f"<p>{words}", f"<p>{words}</p><p hidden>gone"):
        assert udfs.parse_page(page)[5] == words


def test_parts_by_rows_and_bytes():
    parts = [len(p) for (p,) in udfs.sliced((pa.array(["a"] * 2_500 + [None, "x" * 300_000, ""]),))]
    assert parts == [1_000, 1_000, 502, 1]
    assert list(udfs.sliced((pa.array([], pa.string()),))) == []


def plain_runs(text):
    """``canonical_runs`` a character at a time."""
    import unicodedata

    content, _ = udfs.canonical_text(text)
    if content == text:
        return content, [(0, len(text), 0, len(text), True)] if text else []
    units = []
    for i, c in enumerate(text):
        if c in udfs.ZERO_WIDTH or c in udfs.BIDI or (ord(c) < 32 and c not in "\t\n\r") or 127 <= ord(c) < 160:
            continue
        if units and unicodedata.combining(c):
            units[-1][1] += udfs.HOMOGLYPHS.get(c) or c
            units[-1][3] = i + 1
        else:
            units.append([c, udfs.HOMOGLYPHS.get(c) or c, i, i + 1])
    out, at = [], 0
    for first, new, start, end in units:
        new = unicodedata.normalize("NFKC", new)
        same, last = new == first and end == start + 1, out[-1] if out else None
        if same and last and last[4] and last[3] == start:
            out[-1] = (last[0], at + 1, last[2], end, True)
        else:
            out.append((at, at + len(new), start, end, same))
        at += len(new)
    whole = at != len(content) or "".join(unicodedata.normalize("NFKC", u[1]) for u in units) != content
    return content, [(0, len(content), 0, len(text), False)] if whole else out


@given(st.text(alphabet="ab \n\x00​̧́ｅéﬁа가‮\x85", max_size=14))
def test_runs_equal_those_found_a_character_at_a_time(text):
    assert udfs.canonical_runs(text) == plain_runs(text)


def test_spans_of_findings_equal_those_of_expressions(spark):
    texts = ["ig​nore ｅ the l​ｅ́nd of the l", "the l" * 300, "가the l", "", None]
    rule = (detect.Rule("letter-phrase", "the l", "TOOL_COERCION", "low", "review"),)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, raw string").withColumn("m", udfs.canonical_mapped(F.col("raw")))
    want = detect.findings(df.select(F.struct("id", "m").alias("of"), F.col("m.content").alias("c")), rule, "of", "c")
    want = {(r.id, r.start, r.s.start, r.s.end) for r in want.select("of.id", "start", T.source_span(F.col("of.m.runs"), F.col("start"), F.col("end")).alias("s")).collect()}
    rows = df.select("id", "raw", detect.spans(rule, F.col("m.content")).alias("found"))
    got = rows.mapInArrow(udfs.source_spans, "id int, rule_id string, start int, source_start int, source_end int, cut_md5 string").collect()
    assert len(got) == 303 and {(r.id, r.start, r.source_start, r.source_end) for r in got} == want


def test_references_of_one_name_bring_one_row_an_instrument(spark):
    refs = spark.range(1, 1_001).select(F.col("id").cast("int").alias("ref"), F.when(F.col("id") % 2 == 0, "$b").otherwise("u").alias("symbol"), (F.col("id") % 7 / 10).alias("confidence"))
    some = spark.range(40).select(F.col("id").cast("int").alias("instrument_id"), F.concat(F.lit("S"), "id").alias("symbol"), F.lit("B").alias("base_asset"), F.lit("USDT").alias("quote_asset"), F.lit("U").alias("underlying_symbol"))
    assert portfolio.matches(spark.createDataFrame([("B",), ("U",)], "name string"), some).count() == 80
    none = spark.createDataFrame([], "instrument string")
    held = portfolio.impacts(refs, some, spark.createDataFrame([("b",)], "asset string"), none).collect()
    assert len(held) == 40 and {(r.relationship, r.mapping_confidence, r.mapping_basis) for r in held} == {("holding", 0.588, "base_asset")}
    seen = portfolio.impacts(refs, some, spark.createDataFrame([], "asset string"), spark.createDataFrame([("b",)], "instrument string")).collect()
    assert len(seen) == 40 and {(r.relationship, r.mapping_confidence, r.mapping_basis) for r in seen} == {("watchlist", 0.588, "base_asset")}


def test_a_contract_holds_where_nothing_speaks_against_it(spark):
    import random

    from corbel.operators import contracts
    from corbel.operators.schema import Schema

    rng = random.Random(7)
    ids = "_" + "0" * 26
    good = {
        "schema_version": "1.0", "request_id": "req" + ids, "workspace_id": "ws" + ids, "submitted_at": "2024-01-01T00:00:00Z", "idempotency_key": "key-0001", "provenance": {"source_class": "primary", "submitted_by": "me"},
        "input": {"kind": "text", "text": "t", "media_type": "text/plain"}, "extensions": {"a.b": 1},
    }
    inputs = [good["input"], {"kind": "url", "url": "https://a"}, {"kind": "upload", "upload_id": "up" + ids, "media_type": "x", "size_bytes": 5.0, "digest": "sha256:" + "a" * 64}, {"kind": "text"}, {"kind": "other"}, "text", [], None]
    odd = [None, 1, 1.5, "", "x", True, [], {}, ["a", "a"], {"a'b": 1}]
    bodies = [json.dumps(good | {"input": i}) for i in inputs]
    for _ in range(300):
        body = json.loads(json.dumps(good | {"input": rng.choice(inputs)}))
        for _ in range(rng.randrange(1, 3)):
            at = rng.choice([body, *(x for x in body.values() if isinstance(x, dict))])
            key = rng.choice([*at, "more", "a.b"])
            at[key] = rng.choice(odd)
            if rng.random() < 0.3:
                del at[key]
        bodies.append(json.dumps(body))
    bodies += ['{"a":1,"a":2}', "nope", "null", "5", "[]", None]
    other = Schema({
        "type": ["object", "array", "string", "null"], "properties": {"a'b": {"type": "number", "exclusiveMinimum": 1}, 'q"': {"const": 1}, "n": {"anyOf": [{"type": "integer", "maximum": 3}, {"minLength": 2}]}, "l": {"items": {"type": "string", "pattern": "^a$"}, "minItems": 1, "maxItems": 2, "uniqueItems": True}, "o": {"enum": [1, "x", None, [1]]}, "never": False},
        "additionalProperties": {"not": {"type": "boolean"}}, "minProperties": 1, "maxProperties": 4, "items": {"type": "integer"},
    })
    values = [{"a'b": 1}, {"a'b": 2}, {'q"': 1.0}, {'q"': 2}, {"n": 3}, {"n": 4}, {"n": "a"}, {"n": "ab"}, {"n": True}, {"l": []}, {"l": ["a"]}, {"l": ["a", "a"]}, {"l": ["b"]}, {"l": 5}, {"o": None}, {"o": [1]}, {"o": 2}, {"never": 1}, {"z": True}, {"z": 1}, {}, {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5}, [1, 2.0], [1.5], None, "s", 5, True]
    for schema, texts in ((contracts.contract("ingestionRequest"), bodies), (other, [json.dumps(v) for v in values])):
        df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("v", F.try_parse_json("t"))
        rows = df.select("t", (F.size(schema.violations(F.col("t"))) == 0).alias("want"), F.coalesce(schema.holds(F.col("v")), F.lit(False)).alias("got")).collect()
        assert {r.want for r in rows} == {True, False} and [r.t for r in rows if r.want != r.got] == []


def test_requests_are_read_once(spark):
    from corbel.operators import intake

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    ids = "_" + "0" * 26
    body = F.concat(F.lit('{"schema_version":"1.0","request_id":"req' + ids + '","workspace_id":"ws' + ids + '","submitted_at":"2024-01-01T00:00:00Z","idempotency_key":"key-0000'), F.col("id") % 10, F.lit('","provenance":{"source_class":"primary","submitted_by":"me"},"input":{"kind":"url","url":"https://a"},"extensions":{}}'))
    requests = spark.range(100).mapInArrow(seen, "id long").select(F.col("id").alias("position"), F.when(F.col("id") % 20 == 19, "{}").otherwise(body).alias("body"))
    got = intake.accept(requests, spark.createDataFrame([], "idempotency_key string, request_digest string, scan_id string"), "ws" + ids).collect()
    assert sorted(r.outcome for r in got) == ["INVALID"] * 5 + ["created"] * 10 + ["replay"] * 85 and read.value == 100


def test_numbers_in_reach_change_their_layout_alone(spark):
    import random

    from corbel.functions import jsonc

    rng = random.Random(5)
    tokens = ["1.0E21", "5.0E-7", "1e0", "12.50E-3", "0.0E5", "-0.0E-2", "-1.25e+20", "100E2", "0.001E3", "1e99", "9.99999999999999E-99", "123456789012345E6", "1234567890123456E6", "0.000000000000001E-5", "1.0e300", "5e-324", "10.0"]
    tokens += [f"{rng.choice(['', '-'])}{rng.randrange(10 ** rng.randrange(1, 10))}.{rng.randrange(10 ** rng.randrange(1, 9))}{rng.choice('eE')}{rng.choice(['', '+', '-'])}{rng.randrange(100)}" for _ in range(2_000)]
    tokens += [repr(rng.uniform(-1, 1) * 10.0 ** rng.randrange(-40, 40)) for _ in range(500)]

    def shortest(x):
        """As ECMAScript writes it, from Python's shortest digits."""
        if x == 0:
            return "0"
        sign = "-" * (x < 0)
        mantissa, e = next((m, e) for p in range(17) for m, e in [format(abs(x), f".{p}e").split("e")] if float(f"{m}e{e}") == abs(x))
        d, n = mantissa.replace(".", "").rstrip("0"), int(e) + 1
        if len(d) <= n <= 21:
            return sign + d.ljust(n, "0")
        if 0 < n <= 21:
            return sign + d[:n] + "." + d[n:]
        if -6 < n <= 0:
            return sign + "0." + "0" * -n + d
        return f"{sign}{d[0]}{'.' * (len(d) > 1)}{d[1:]}e{'+' if n > 0 else '-'}{abs(n - 1)}"

    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", jsonc.number(F.col("t")).alias("n")).collect()
    assert [(r.t, r.n, shortest(float(r.t))) for r in got if r.n != shortest(float(r.t))] == []


def test_both_orders_of_keys_parse_a_text_once(spark):
    from corbel.plans import contracts as plans

    plan = plans.canonical_forms(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") == 2


def test_collapsed_space_leaves_single_blanks_where_they_are(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  \t\n\x0b   ﻿​\u0085") for _ in range(rng.randrange(14))) for _ in range(500)] + ["x " * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.collapse_space(F.col("t")).alias("got"), F.trim(F.regexp_replace("t", T.ECMA_SPACE, " ")).alias("want"))
    assert [r for r in df.collect() if r.got != r.want] == []


def test_records_are_listed_once_whatever_comes_of_them(spark):
    from corbel.operators import representation

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    fields = F.transform(F.sequence(F.lit(1), F.when(F.col("id") % 5 == 0, 40).otherwise(3)), lambda i: F.struct(i.cast("string").alias("id"), F.when(F.col("id") % 2 == 0, "The  letteré").otherwise("the letter the l").alias("content")))
    records = spark.range(20).mapInArrow(seen, "id long").select("id", fields.alias("fields"))
    rules = (detect.Rule("letter-phrase", "the l", "TOOL_COERCION", "low", "review"), detect.Rule("other", "the letter", "TOOL_COERCION", "low", "review"))
    listed = representation.representations(records, "id", "fields")
    got = listed.select("id", "outcome", F.inline_outer(representation.counts(rules))).collect()
    assert read.value == 20 and {(r.id % 5 == 0, r.outcome) for r in got} == {(True, "too_many_fields"), (False, "ok")}
    want = {tuple(r) for r in representation.scan(listed, rules, "id").groupBy("id", "kind", "rule_id").agg(F.count("*").alias("n")).collect()}
    summed = {}
    for r in got:
        if r.outcome == "ok":
            summed[r.id, r.kind, r.rule_id] = summed.get((r.id, r.kind, r.rule_id), 0) + r.n
    assert {(*k, n) for k, n in summed.items()} == want and {r.rule_id for r in got} == {"letter-phrase", "other", None}
