import decimal
import hashlib
import json
import random
import re
import struct

import pytest
from pyspark.sql import functions as F

from corbel.functions import jsonc
from corbel.operators import contracts, detect, intake, listing
from corbel.operators.schema import KNOWN, Schema, java_pattern


# canonical JSON
def js_number(x):
    """A double as ECMAScript writes it, from Python's shortest digits."""
    if x == 0:
        return "0"
    sign, x = ("-" if x < 0 else ""), abs(float(x))
    mantissa, exponent = f"{x!r}e0".split("e")[:2] if "e" in repr(x) else (repr(x), "0")
    whole, _, part = mantissa.partition(".")
    digits, n = (whole + part).lstrip("0"), len(whole) + int(exponent) - (len(whole + part) - len((whole + part).lstrip("0")))
    digits = digits.rstrip("0")
    k = len(digits)
    if k <= n <= 21:
        return sign + digits + "0" * (n - k)
    if 0 < n <= 21:
        return sign + digits[:n] + "." + digits[n:]
    if -6 < n <= 0:
        return sign + "0." + "0" * -n + digits
    return sign + digits[0] + ("." + digits[1:] if k > 1 else "") + f"e{'+' if n > 0 else '-'}{abs(n - 1)}"


def js_text(v):
    if isinstance(v, dict):
        return "{" + ",".join(f"{js_text(k)}:{js_text(v[k])}" for k in sorted(v, key=lambda k: k.encode("utf-16-be"))) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(js_text, v)) + "]"
    return js_number(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else json.dumps(v, ensure_ascii=False)


def some_json(rng, depth=0):
    kind = rng.randrange(9 if depth < 4 else 6)
    if kind == 0:
        return rng.choice((True, False, None))
    if kind == 1:
        return rng.choice((0, -0.0, 1, -7, 10**15, 2**53, 2**53 + 1, 10**20, 10**21, 123456789012345678901234567890, -(10**17)))
    if kind == 2:
        return struct.unpack("<d", rng.randbytes(7) + bytes([rng.choice((0x3F, 0x40, 0x00, 0x7F, 0xBF))]))[0] if rng.random() < 0.9 else 5e-324
    if kind == 3:
        return round(rng.uniform(-1000, 1000), rng.randrange(8))
    if kind in (4, 5):
        return "".join(rng.choice(("a", "Z", "_", "1.50", '"', "\\", "\x0b", "\x1f", "\n", "/", "é", "～", "😀", "\x7f", " ", "e10", "-0", "[1,2]")) for _ in range(rng.randrange(8)))
    if kind == 6:
        return [some_json(rng, depth + 1) for _ in range(rng.randrange(5))]
    return {"".join(rng.choice("abAB_1é～😀\"\\") for _ in range(rng.randrange(1, 4))): some_json(rng, depth + 1) for _ in range(rng.randrange(6))}


def finite(v):
    if isinstance(v, dict):
        return {k: finite(x) for k, x in v.items()}
    return [finite(x) for x in v] if isinstance(v, list) else 0.5 if isinstance(v, float) and (v != v or abs(v) == float("inf")) else v


def test_canonical_json_equals_numbers_and_keys_of_ecmascript(spark):
    rng = random.Random(11)
    values = [finite(some_json(rng)) for _ in range(600)] + [{"list": [1.0, "x"], "Map": {"κ": -0.0, "k": 1e21}}, 4.35, 5.684341886080802e-14, 2e-3, 1e23, 9007199254740993]
    texts = [json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice((None, 1))) for v in values]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(jsonc.canonical(F.col("t"))).collect()]
    assert got == [js_text(v) for v in values]


def test_canonical_json_of_other_writings_and_of_none(spark):
    rows = ['{"b":[1.50e1,1E2],"a":0.10}', '{"a":1e-1,"b":[15,100.0]}', '{"a":1,"a":1}', "[1e400]", "nope", None, "", '"\\u00e9"', "[" * 40 + "]" * 40, "-0.0"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r[0] for r in df.select(jsonc.canonical(F.col("t"))).collect()]
    assert got == ['{"a":0.1,"b":[15,100]}'] * 2 + [None] * 5 + ['"é"', "[" * 40 + "]" * 40, "0"]
    assert spark.range(1).select(jsonc.digest(F.lit(got[0]))).first()[0] == "sha256:" + hashlib.sha256(got[0].encode()).hexdigest()
    with pytest.raises(Exception, match="too many levels"):
        df.select(jsonc.canonical(F.col("t"), "locale", 5)).collect()


def test_keys_in_english_order(spark):
    text = '{"b":1,"B":2,"a_b":3,"ab":4,"é":{"z":[{"Y":1,"y":2}],"A":5},"f":6,"1":7,"":8}'
    assert spark.range(1).select(jsonc.canonical(F.lit(text), "locale", 4)).first()[0] == '{"":8,"1":7,"a_b":3,"ab":4,"b":1,"B":2,"é":{"A":5,"z":[{"y":2,"Y":1}]},"f":6}'


# schemas
def same(a, b):
    return js_text(a) == js_text(b)


def brute_violations(s, v, root, path="$"):
    """By the keywords' definitions, a value at a time."""
    if isinstance(s, bool):
        return set() if s else {f"{path}:false"}
    out = set()
    if "$ref" in s:
        node = root
        for name in s["$ref"].split("/")[1:]:
            node = node[name]
        out |= brute_violations(node, v, root, path)
    say = lambda w: out.add(f"{path}:{w}")
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    types = {"string": isinstance(v, str), "number": number, "integer": number and v == int(v), "boolean": isinstance(v, bool), "null": v is None, "object": isinstance(v, dict), "array": isinstance(v, list)}
    if "type" in s and not any(types[t] for t in ([s["type"]] if isinstance(s["type"], str) else s["type"])):
        say("type")
    if "const" in s and not same(s["const"], v):
        say("const")
    if "enum" in s and not any(same(x, v) for x in s["enum"]):
        say("enum")
    if isinstance(v, str):
        if "pattern" in s and not re.search(s["pattern"].replace("$", r"\Z"), v):
            say("pattern")
        if len(v) < s.get("minLength", 0):
            say("minLength")
        if len(v) > s.get("maxLength", 1e9):
            say("maxLength")
    if number:
        for w, bad in (("minimum", v < s.get("minimum", -1e99)), ("maximum", v > s.get("maximum", 1e99)), ("exclusiveMinimum", v <= s.get("exclusiveMinimum", -1e99)), ("exclusiveMaximum", v >= s.get("exclusiveMaximum", 1e99))):
            if bad:
                say(w)
    if isinstance(v, list):
        if len(v) < s.get("minItems", 0):
            say("minItems")
        if len(v) > s.get("maxItems", 1e9):
            say("maxItems")
        if s.get("uniqueItems") and len({js_text(x) for x in v}) < len(v):
            say("uniqueItems")
        for k, x in enumerate(v if "items" in s else ()):
            out |= brute_violations(s["items"], x, root, f"{path}[{k}]")
    if isinstance(v, dict):
        for name in s.get("required", ()):
            if name not in v:
                say(f"required:{name}")
        if len(v) < s.get("minProperties", 0):
            say("minProperties")
        if len(v) > s.get("maxProperties", 1e9):
            say("maxProperties")
        known = s.get("properties", {})
        for name, x in v.items():
            if name in known:
                out |= brute_violations(known[name], x, root, f"{path}.{name}" if re.fullmatch(r"\w+", name, re.A) else f"{path}['{name}']")
            elif s.get("additionalProperties") is False:
                say("additionalProperties")
            elif isinstance(s.get("additionalProperties"), dict):
                out |= brute_violations(s["additionalProperties"], x, root, f"{path}['{name}']")
            if "propertyNames" in s and brute_violations(s["propertyNames"], name, root):
                say("propertyNames")
    for one in s.get("allOf", ()):
        out |= brute_violations(one, v, root, path)
    for w in ("oneOf", "anyOf"):
        if w in s:
            each = [brute_violations(one, v, root, path) for one in s[w]]
            fit = sum(not e for e in each)
            if not (fit == 1 if w == "oneOf" else fit):
                out |= set().union(*each) | {f"{path}:{w}"}
    if "not" in s and not brute_violations(s["not"], v, root, path):
        say("not")
    return out


ID, SHA, AT = "A" * 26, "sha256:" + "f" * 64, "2024-02-03T04:05:06.789Z"
POLICY = {"policy_id": f"policy_{ID}", "version": "1.2.3", "digest": SHA}
CLAIM = {"claim_id": f"claim_{ID}", "kind": "guidance", "statement": "s", "value": {"decimal": "1.5", "unit": "m"}, "verification": "pending", "confidence_bps": 10, "citations": [{"source_id": f"src_{ID}", "snapshot_digest": SHA, "locator": {"page": 1}}]}
GOOD = {
    "claim": CLAIM,
    "sourceRecord": {"schema_version": "1.0", "source_id": f"src_{ID}", "kind": "news", "display_name": "n", "identity_state": "unknown", "canonical_origins": ["https://a", "https://b"], "created_at": AT, "updated_at": AT, "source_tier": "blocked", "extensions": {}},
    "policyVerdict": {"schema_version": "1.0", "verdict_id": f"v1_{ID}", "scan_id": f"scan_{ID}", "evaluated_at": AT, "disposition": "allow", "policy": POLICY, "finding_ids": [f"f1_{ID}"], "reason_codes": ["ABC"], "extensions": {"a.b": [1]}},
    "contextCapsule": {
        "schema_version": "1.0", "capsule_id": f"cap_{ID}", "workspace_id": f"ws_{ID}", "scan_id": f"scan_{ID}", "input_digest": SHA, "created_at": AT, "as_of": AT, "subject": {"kind": "etf", "symbols": ["A", "B"]}, "claims": [CLAIM, CLAIM],
        "findings": [{"finding_id": f"f1_{ID}", "category": "other", "severity": "low", "detector_id": "d", "reason_code": "ABC", "location": {"representation": "raw", "text_start": 0}}],
        "evidence": [{"evidence_id": f"ev_{ID}", "source_id": f"src_{ID}", "snapshot_digest": SHA, "identity_state": "verified", "retrieved_at": AT, "freshness": "stale", "canonical_url": "https://x"}],
        "conflicts": [{"conflict_id": f"con_{ID}", "claim_ids": [f"claim_{ID}", f"claim_{'B' * 26}"], "status": "resolved"}], "disposition": "block", "policy": POLICY, "components": [{"component": "engine", "version": "1", "digest": SHA}],
        "extensions": {}, "signature": {"algorithm": "Ed25519", "key_id": f"key_{ID}", "signed_at": AT, "value": "a" * 86},
    },
}


def mutated(rng, v):
    """The value with one place altered: dropped, doubled, renamed, or of another kind."""
    v = json.loads(json.dumps(v))
    spots = []

    def walk(x):
        for k, y in x.items() if isinstance(x, dict) else enumerate(x):
            spots.append((x, k))
            if isinstance(y, (dict, list)):
                walk(y)

    walk(v)
    at, k = rng.choice(spots)
    how = rng.randrange(5)
    if how == 0:
        del at[k]
    elif how == 1 and isinstance(at, list):
        at.append(at[k])
    elif how == 1:
        at["a.b"] = at[k]
    elif how == 2 and isinstance(at[k], str):
        at[k] += "\n"
    else:
        at[k] = rng.choice((None, True, 5, -1, 1.0, 10001, 2.5, "", "x", [], {}, ["A"], "1.0", {"decimal": "1"}))
    return v


@pytest.mark.parametrize("name", list(GOOD))
def test_contracts_equal_the_keywords_definitions(spark, name):
    rng, root = random.Random(name), {"$defs": contracts.DEFINITIONS}
    values = [GOOD[name]] + [mutated(rng, mutated(rng, GOOD[name]) if rng.random() < 0.3 else GOOD[name]) for _ in range(150)]
    got = spark.createDataFrame([(json.dumps(v),) for v in values], "t string").select(contracts.contract(name).violations(F.col("t"))).collect()
    assert got[0][0] == []
    for r, v in zip(got, values):
        assert r[0] == sorted(brute_violations({"$ref": f"#/$defs/{name}"}, v, root)), v


ODD = {
    "type": ["object", "array", "number"], "minProperties": 1, "maxProperties": 4, "propertyNames": {"maxLength": 3, "pattern": "^[a-z.]+$"}, "additionalProperties": {"anyOf": [{"type": "null"}, {"type": "integer", "exclusiveMinimum": 0, "exclusiveMaximum": 5}]},
    "properties": {"a.b": {"enum": [1, "x", [1, 2], {"k": 1.0}, None]}, "b": {"allOf": [{"minLength": 2}, {"maxLength": 3}], "not": {"const": "bad"}}, "c": {"const": {"x": [True]}}, "d": False, "e": {"items": {"type": ["string", "null"]}, "uniqueItems": True, "minItems": 1, "maxItems": 3}},
}


def test_odd_schemas_equal_the_keywords_definitions(spark):
    values = [{}, {"a.b": 1.0}, {"a.b": "1"}, {"a.b": [1, 2.0]}, {"a.b": {"k": 1}}, {"a.b": None}, {"a.b": True}, {"b": "bad"}, {"b": "x"}, {"b": "long!"}, {"b": 5}, {"c": {"x": [True]}}, {"c": {"x": [1]}}, {"d": 1}, {"e": [1, "1", None]}, {"e": []}, {"e": ["a", "a"]}, {"e": ["a", "b", None, "c"]}]
    values += [{"z": None}, {"z": 3}, {"z": 3.5}, {"z": 0}, {"zzzz": 1}, {"Z": 1}, {"p": 1, "q": 2, "r": 3, "s": 4, "t": 5}, [1], "x", 7, None, True, {"z": 4.0}]
    got = spark.createDataFrame([(json.dumps(v),) for v in values], "t string").select(Schema(ODD).violations(F.col("t"))).collect()
    for r, v in zip(got, values):
        assert r[0] == sorted(brute_violations(ODD, v, ODD)), v


def test_schemas_that_are_refused_and_texts_that_are_no_json(spark):
    for bad in ({"format": "email"}, {"$ref": "#/$defs/no"}, {"$ref": "other.json"}, {"$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}, "$ref": "#/$defs/a"}, {"properties": {"x": {"multipleOf": 2}}}, {"propertyNames": {"minItems": 1}}):
        with pytest.raises(ValueError):
            Schema(bad)
    assert "oneOf" in KNOWN and java_pattern(r"^a[$]\$$") == r"^a[$]\$\z"
    rows = spark.createDataFrame([(None,), ("{",), ('{"a":1,"a":2}',), ("1",)], "t string")
    assert [r[0] for r in rows.select(Schema({"type": "number"}).violations(F.col("t"))).collect()] == [["$:json"]] * 3 + [[]]


# intake
def test_only_strings_are_texts(spark):
    rule = detect.Rule("r", "bad words", "TOOL_COERCION", "high", "block")
    rows = [(1, '{"input":{"text":"ok"}}'), (2, '{"input":{"text":"bad WORDS"}}'), (3, '{"input":{"text":5}}'), (4, '{"input":{"text":{"t":"bad words"}}}'), (5, '{"input":["bad words"]}'), (6, None), (7, '{"input":{"text":"bad words","kind":"feed_event","source_id":7}}')]
    decided, found = intake.process(spark.createDataFrame([(i, "queued", e) for i, e in rows], "scan_id long, state string, envelope string"), (rule,))
    assert [(r.scan_id, r.state) for r in decided.orderBy("scan_id").collect()] == [(1, "allowed"), (2, "blocked"), (3, "review"), (4, "review"), (5, "review"), (6, "review"), (7, "blocked")]
    assert sorted(r.scan_id for r in found.where("reason_code = 'INPUT_REQUIRES_REVIEW'").collect()) == [3, 4, 5, 6]


def test_requests_in_other_writings_are_the_same(spark):
    body = {"schema_version": "1.0", "request_id": f"req_{ID}", "workspace_id": f"ws_{ID}", "submitted_at": AT, "idempotency_key": "abcdefgh", "provenance": {"source_class": "primary", "submitted_by": "x"}, "input": {"kind": "upload", "upload_id": f"up_{ID}", "media_type": "m", "size_bytes": 10, "digest": SHA}, "extensions": {}}
    turned = json.dumps(dict(reversed(body.items())), indent=2).replace(": 10", ": 1.0e1")
    other = json.dumps({**body, "request_id": f"req_{'B' * 26}"})
    big = json.dumps({**body, "idempotency_key": "k" * 9, "input": {**body["input"], "size_bytes": 100_000_001}})
    rows = [(1, turned), (2, json.dumps(body)), (3, other), (4, big), (5, "[]"), (6, None), (7, json.dumps({**body, "workspace_id": f"ws_{'B' * 26}"})), (8, json.dumps({**body, "idempotency_key": "t" * 9, "input": {"kind": "text", "text": "é" * 500_001, "media_type": "text/plain"}}))]
    got = {r.position: r for r in intake.accept(spark.createDataFrame(rows, "position long, body string"), spark.createDataFrame([], "idempotency_key string, request_digest string, scan_id string"), f"ws_{ID}").collect()}
    assert {k: r.outcome for k, r in got.items()} == {1: "created", 2: "replay", 3: "CONFLICT", 4: "TOO_LARGE", 5: "INVALID", 6: "INVALID", 7: "DENIED", 8: "TOO_LARGE"}
    assert got[1].request_digest == got[2].request_digest == "sha256:" + hashlib.sha256(js_text(body).encode()).hexdigest() and got[1].input_digest == SHA


# holdings
def test_quantities_keep_their_digits(spark):
    rows = [("a", "x", "5.500", None, None, None), ("b", "x", None, "0.1234567890123456789", "9" * 60, None), ("c", "x", None, "0.0000000000000000004", "0", "0.0"), ("d", "x", "-0.00", "1", None, None), ("e", "x", "1" * 101, None, None, None), ("f", "x", "-1", None, None, None), ("g", "x", None, "-1", "00.50", "nope"), ("h", "x", "007", None, None, None), ("i", "x", None, "0.75", "0.25", None)]
    got = {r.account_id: r.quantity or r.error for r in listing.holdings(spark.createDataFrame(rows, "account_id string, coin string, balance string, available string, frozen string, locked string")).collect()}
    assert got == {"a": "5.500", "b": "9" * 60 + ".1234567890123456789", "c": "0.0000000000000000004", "e": "INVALID_BALANCE", "g": "0.5", "h": "007", "i": "1"}


def test_holdings_are_worked_out_once(spark):
    rng = random.Random(5)
    number = lambda: "".join(rng.choices("0123456789", k=rng.choice((1, 2, 16, 17, 18)))) + rng.choice(("", "." + "".join(rng.choices("059", k=rng.choice((1, 14, 15, 16, 17))))))
    rows = [(None if rng.random() < 0.05 else k // 3, rng.choice(("x", "y", "z", "u", "v", " W ")) if rng.random() < 0.98 else "no!", number() if rng.random() < 0.2 else None, *(number() if rng.random() < 0.7 else rng.choice((None, "-1", "0", "0.0")) for _ in range(3))) for k in range(900)]
    accounts, want = {}, []
    for account, coin, balance, *parts in rows:
        there = [decimal.Decimal(p) for p in parts if p and p[0] != "-"]
        with decimal.localcontext(prec=200):
            total = format(sum(there), "f") if there else None
        total = total and (total.rstrip("0").rstrip(".") if "." in total else total)
        accounts.setdefault(account, []).append((None if coin == "no!" else coin.strip().upper(), balance or total))
    for account, held in accounts.items():
        names = [a for a, _ in held]
        error = "INVALID_IDENTIFIER" if None in names else "DUPLICATE_ASSET" if len(set(names)) < len(names) else "INVALID_BALANCE" if None in [q for _, q in held] else None
        want += [(account, None, None, error)] if error else [(account, a, q, None) for a, q in held if q.strip("0.")]
    df = listing.holdings(spark.createDataFrame(rows, "account_id long, coin string, balance string, available string, frozen string, locked string").repartition(3))
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str) and {e for *_, e in want} == {None, "INVALID_IDENTIFIER", "DUPLICATE_ASSET", "INVALID_BALANCE"}
    plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(account_id") == 1 and "Join" not in plan and "Union" not in plan
    parts = [[number() for _ in range(n)] for n in (1, 2, 9, 9, 9, 10, 12) for _ in range(20)] + [["9" * 17] * 9, ["9." + "9" * 15] * 9, ["0"], ["00.0", "000"], ["0.0000001"]]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in parts], "p array<string>").select(listing.decimal_total(F.col("p"))).collect()]
    with decimal.localcontext(prec=200):
        texts = [format(sum(map(decimal.Decimal, p)), "f") for p in parts]
    assert got == [t.rstrip("0").rstrip(".") if "." in t else t for t in texts]


def test_capsules_are_written_and_envelopes_read_once(spark):
    from corbel.operators import capsule

    rule = detect.Rule("r", "bad words", "TOOL_COERCION", "high", "block")
    rows = [(f"scan_{i}", "queued", e) for i, e in enumerate(('{"input":{"text":"ok"}}', '{"input":{"text":"bad words, BAD words"}}', '{"input":{}}', None))]
    decided, found = intake.process(spark.createDataFrame(rows, "scan_id string, state string, envelope string"), (rule,))
    ended = decided.where("outcome = 'processed' and state in ('allowed', 'blocked', 'review')")
    assert ended._jdf.queryExecution().executedPlan().toString().count("parseJson(envelope") == 1
    scans = ended.select("scan_id", F.lit(f"ws_{ID}").alias("workspace_id"), F.lit(SHA).alias("input_digest"), F.lit(AT).alias("created_at"), "state")
    capsules = capsule.compose_contract(scans, found, {"policy_id": f"policy_{ID}", "version": "1.2.3", "digest": SHA}, {"component": "engine", "version": "1", "digest": SHA})
    plan = capsules._jdf.queryExecution().executedPlan().toString()
    assert plan.count("StructField(schema_version") == 1
    got = [json.loads(r.capsule) for r in capsules.orderBy("scan_id").collect()]
    assert [(c["disposition"], len(c["findings"])) for c in got] == [("allow", 0), ("block", 2), ("review", 1), ("review", 1)]


def test_numbers_beyond_a_double_are_told_from_digits_of_digests(spark):
    beyond = ["1e400", " -1E+400", "[1e400]", '{"a":1.5e999}', '{"a": -1e0400}', "[0,\n1e400]", '{"s":"x","a":[' + "9" * 400 + "]}", "[1,1e9999]"]
    good = ['"e123"', '{"a":"sha256:1e400e999"}', '["12e345f", ",1e400"]', '{"1e400":1}', "[1e-400]", "[0." + "1" * 400 + "]", '{"a":"' + "1" * 400 + '"}', "[12]"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in beyond + good], "t string").select(jsonc.canonical(F.col("t"))).collect()]
    assert got[: len(beyond)] == [None] * len(beyond) and [json.loads(t) for t in got[len(beyond) :]] == [json.loads(t) for t in good]
