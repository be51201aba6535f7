import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corbel.llm import chat, queries, resample, vectors


# importance resampling
def brute_resample(docs, items, orders, buckets=10_000, min_words=20, percent=10, seed=2024):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    grams = lambda w: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, orders + 1) for i in range(len(w) - n + 1)]
    s, t = (Counter(b for _, x in rows for b in grams(cut(x))) for rows in (docs, items))
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1.0) * big_s) / ((s[b] + 1.0) * big_t)))
    rows = []
    for i, x in docs:
        w = cut(x)
        f = grams(w)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append(((-score, i is None, i or 0, hashlib.md5((x or "").encode()).hexdigest()), len(w) >= min_words, (i, len(f), weight, score)))
    order = sorted(r for r in rows if r[1])
    n = len(order) * percent // 100
    return sorted([(*r[2], k + 1 if k < n else None) for k, r in enumerate(order)] + [(*r[2], None) for r in rows if not r[1]], key=str)


def word_rows(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Äb", "é9", "日本"]
    return [(i, rng.choice((" ", ", ", "\n")).join(rng.choice(words) for _ in range(rng.randrange(0, 60))).title()) for i in range(n)]


@pytest.mark.parametrize("orders", [1, 3])
def test_resample_equals_brute_force(spark, orders):
    docs = word_rows(1, 150) + [(200, None), (201, ""), (202, " .,"), (203, "x " * 30_000), (None, "solo word " * 15), (None, "solo word " * 15), (None, None), (3, "again " * 40), (7, "twice " * 25), (7, "twice " * 25)]
    items = [*word_rows(2, 20), (None, "w1 w2 w3"), (5, None)]
    frame = spark.createDataFrame([(i, t, 1, "c") for i, t in docs], "doc_id long, text string, bucket long, word string")
    got = resample.resample(frame, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, gain long"), orders=orders, percent=40)
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample(docs, items, orders, percent=40)


def test_resample_of_empty_tables(spark):
    none, docs = spark.createDataFrame([], "item_id long, text string"), word_rows(3, 30)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, resample.resample(frame, none).collect()), key=str) == brute_resample(docs, [], 1)
    assert resample.resample(frame.limit(0), frame.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_order_one_shuffles_counts_only(spark):
    plan = resample.features(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit(1).cast("long").alias("copies")), 1, 100)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


# chat logs
LOG = "conv_id long, seq long, kind string, message string, role string, text string"
ODD = ["", "plain", "\\### Assistant: </turn> ok", "<turn:user>\nx\n</turn>\n", "<\\turn <\\\\/turn </turn", "a\\", "<", "\n</turn>", "<turn" * 3, "日本 😀 </turn>", "\\b\\g>"]


def brute_fold(log):
    """Events one by one: messages in order of their beginning, cut off where an earlier one is made again."""
    out = {}
    for conv in {e[0] for e in log}:
        open_ = {}
        begun = {}
        for e in sorted({e for e in log if e[0] == conv and e[1] is not None and e[2] in ("message", "delta", "edit", "regenerate")}, key=lambda e: (e[1], e[2])):
            if e[2] == "message":
                begun.setdefault(e[3], e[1])
        for _, seq, kind, name, role, text in sorted({e for e in log if e[0] == conv and e[1] is not None}, key=lambda e: (e[1], str(e[2]))):
            if name not in begun or kind not in ("message", "delta", "edit", "regenerate"):
                continue
            m = open_.setdefault(name, {"role": None, "text": "", "gone": False})
            if kind == "message" and m["role"] is None:
                m["role"] = role or ""
            m["text"] = (m["text"] if kind == "delta" else "") + (text or "")
            if kind == "regenerate":
                for other, x in open_.items():
                    x["gone"] |= begun[name] < begun[other] < seq
        out[conv] = [(m["role"], m["text"]) for name, m in sorted(open_.items(), key=lambda x: begun[x[0]]) if not m["gone"]]
    return out


def brute_summary(turns):
    rows = []
    for conv, ts in turns.items():
        learned = "".join(t for r, t in ts if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        if ts:
            rows.append((conv, len(ts), sha("".join(f"{r}\n{t}\n" for r, t in ts)), len(learned), sha(learned)))
    return sorted(rows, key=str)


def random_log(seed, convs, steps):
    rng, log = random.Random(seed), []
    for conv in convs:
        seq, names = 0, []
        for _ in range(steps):
            seq += rng.randrange(1, 3)
            kind = rng.choice(("message", "delta", "delta", "edit", "regenerate")) if names else "message"
            if kind == "message":
                names.append(f"m{len(names)}")
            name = names[-1] if kind == "message" else rng.choice(names[-4:])
            log.append((conv, seq, kind, name, rng.choice(("user", "assistant", "tool>\\g\n", None)) if kind == "message" else None, None if kind == "regenerate" else rng.choice([*ODD, None])))
    return log


@pytest.mark.parametrize("parts", [1, 7])
def test_logs_are_folded_as_events_one_by_one(spark, parts):
    log = random_log(4, (1, 2, None), 60) + random_log(5, (9,), 1_500)
    log += [log[0], log[3], (1, None, "message", "m0", "user", "x"), (1, 2_000, "shout", "m0", "user", "x"), (1, 2_001, "delta", "nowhere", "user", "x")]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        formatted = chat.render(spark.createDataFrame(log, LOG).withColumn("text", F.col("text")).repartition(3))
        got = sorted((tuple(r)[:5] for r in chat.summary(formatted).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert got == brute_summary(brute_fold(log))
    assert formatted.where("conv_id = 9").count() > 1  # a long conversation is many rows


def test_texts_and_roles_come_back_whatever_they_hold(spark):
    rows = [(1, k, r, t) for k, (r, t) in enumerate((r, t) for r in ("assistant", "us>er\\", "<turn:x>\n</turn>\n", "") for t in ODD)]
    formatted = chat.render(chat.events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), size=3))
    got = [(t["role"], t["text"]) for r in sorted(chat.parse(formatted).collect(), key=lambda r: (r["part"], r["block"])) for t in r["turns"]]
    assert got == [(r, t) for _, _, r, t in rows]
    for r in chat.parse(formatted).collect():
        assert r["formatted"].count(chat.CLOSE) == len(r["turns"]) == len(re.findall(r"<turn:", r["formatted"])) and "<turn" not in "".join(r["formatted"][m["start"] : m["start"] + m["length"]] for m in r["mask"])


def test_chat_of_nulls_repeats_long_texts_and_empty_tables(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, "assistant", "b"), (1, 1, None, "x" * 200_000), (None, 5, "assistant", "n")]
    frame = spark.createDataFrame([(*r, "c", 0) for r in rows], "conv_id long, turn long, role string, text string, seq string, part int")
    got = sorted((tuple(r)[:5] for r in chat.summary(chat.render(chat.events(frame))).collect()), key=str)
    assert got == brute_summary({1: [("assistant", "b"), ("user", ""), ("user", ""), ("", "x" * 200_000)], None: [("assistant", "n")]})
    assert chat.summary(chat.render(chat.events(frame.limit(0)))).count() == 0


def test_planted_conversation_is_edited_and_regenerated(spark):
    row = queries.op12_chat(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    text = r"\### Assistant: </turn> ok"
    assert tuple(row)[:5] == brute_summary({-7: [("user", text), ("assistant", text)]})[0]


# vector codes
def brute_codes(rows, parts, entries, rounds):
    kept = sorted(((i, [math.floor(4096 * float(x)) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), c)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        found = [[near(v, p)[1] for _, v, _ in kept] for p in range(parts)]
        books = [[[sum(c) // len(c) for c in zip(*own)] if (own := [cut(v, p) for (_, v, _), k in zip(kept, found[p]) if k == e]) else books[p][e] for e in range(len(books[p]))] for p in range(parts)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, "".join(f"{near(v, p)[1]:02x}" for p in range(parts)), sum(near(v, p)[0] for p in range(parts)), label) for i, v, label in kept]
    by = Counter()
    for _, _, e, label in out:
        by[label] += e
    return sorted([(i, c, e, by[label], sha) for i, c, e, label in out], key=str), books


def vector_rows(n, width=16):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=width) * (30 if i % 9 == 0 else 1)], [None, 1, 2][i % 3]) for i in rng.permutation(n)]
    bad = [(500, None, 1), (501, [None] + [0.0] * (width - 1), 1), (502, [float("nan")] * width, 1), (503, [float("inf")] + [0.0] * (width - 1), 2), (504, [], 2)]
    return rows + bad + [(3, rows[0][1], 2), (3, rows[0][1], 2), (None, [0.5] * width, None), *((600 + k, [0.25] * width, 1) for k in range(40))]


KIND = "vec_id long, embedding array<float>, label int, code string, v int"


@pytest.mark.parametrize(("n", "parts", "entries"), [(200, 8, 16), (200, 1, 5), (4, 4, 256)])
def test_codes_equal_brute_force(spark, n, parts, entries):
    rows = vector_rows(n)
    got = vectors.compress(spark.createDataFrame([(*r, "x", 1) for r in rows], KIND).repartition(5), parts=parts, entries=entries)
    assert sorted(map(tuple, got.collect()), key=str) == brute_codes(rows, parts, entries, 6)[0]


def test_vectors_of_empty_unlike_and_huge_rows(spark):
    frame = lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], KIND)
    assert vectors.compress(frame([])).count() == 0 and vectors.compress(frame([(1, None, 0), (2, [float("nan")], 0)])).count() == 0
    for rows in ([(1, [0.0] * 8, 0), (2, [0.0] * 16, 0)], [(1, [0.0] * 9, 0)], [(1, [1e9] * 8, 0)]):
        with pytest.raises(ValueError):
            vectors.compress(frame(rows))


def test_codes_decode_to_their_entries(spark):
    rows = vector_rows(60)
    ints = vectors.integers(spark.createDataFrame([(*r, "x", 1) for r in rows], KIND))
    books = vectors.fit(ints, 4, 8, 3)
    back = vectors.decoded(vectors.encode(ints, books), books).join(ints.select("vec_id", "v"), "vec_id").where("vec_id < 60 and vec_id <> 3").collect()
    assert len(back) == 59 and all(sum((a - b) ** 2 for a, b in zip(r["vector"], r["v"])) == r["error"] for r in back)
