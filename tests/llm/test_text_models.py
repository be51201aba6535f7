import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corbel.llm import language, ppm, quality, queries
from corbel.llm.textstats import NAMES, stats

EN, DE = "the cat and the dog of this house are in the garden with us", "der hund und die katze von diesem haus sind in dem garten mit uns"
FR, ES = "le chat et le chien de cette maison sont dans le jardin avec nous", "el gato y el perro de esta casa y todos en el campo con nosotros"


def corpus(n=40):
    rows = []
    for lang, text in zip(("en", "de", "fr", "es"), (EN, DE, FR, ES)):
        w = text.split()
        for k in range(n):
            rows.append((len(rows), " ".join(w[(k * 7 + j * 5) % len(w)] for j in range(12)), lang, "s", "clash"))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, score string"


def test_language_by_family_with_odd_rows(spark):
    docs = spark.createDataFrame(corpus() + [(900, None, "en", None, None), (901, "123 !?", "fr", None, None), (902, "", None, None, None), (903, "A", "en", "s", ""), (0, EN, "en", "s", "")], SCHEMA)
    train = docs.where("doc_id % 4 <> 2")
    got = language.identify(docs, train).collect()
    assert len(got) == docs.count()
    by = {r.id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got)
    truth = {r[0]: r[2] for r in corpus()}
    held = [i for i in truth if i % 4 == 2]
    assert np.mean([by[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all(by[i].family_pred == language.family(by[i].lang_pred) for i in truth)


def test_language_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None, None, None)], SCHEMA)
    assert [r.lang_pred for r in language.identify(docs, docs).collect()] == ["und"]
    assert language.identify(docs.where("false"), docs).count() == 0


def test_statistics_take_any_text():
    for t in (b"", b" ", b"a", b"\n\n", b"aaaa" * 50_000, "é ñ".encode(), b"A, b. C!"):
        x = np.array(stats(t))
        assert len(x) == len(NAMES) and np.isfinite(x).all()


def test_pool_adjacent():
    assert quality.pool_adjacent(np.array([1.0, 0.0, 1.0]), np.array([1.0, 1.0, 1.0])).tolist() == [0.5, 0.5, 1.0]


def test_quality_learns_and_scores_every_row(spark):
    good = [(i, f"{EN} number {i}.", "en", "s", "") for i in range(80)]
    bad = [(100 + i, f"BUY!!! {i} $$$ ### " * 8, "en", "s", "") for i in range(80)]
    docs = spark.createDataFrame(good + bad + [(900, None, None, None, None), (901, "", None, None, None), (0, good[0][1], "en", "s", "")], SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(80)] + [(100 + i, 0) for i in range(80)] + [(5, 0), (6, None), (5000, 1)], "doc_id long, quality int")
    got = quality.quality(docs, labels, lambda c: c % 5 != 0).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    s = {r.id: r.score for r in got}
    assert np.mean([s[i] >= 0.3 for i in range(0, 80, 5)]) == 1 and np.mean([s[100 + i] < 0.3 for i in range(0, 80, 5)]) == 1
    assert quality.quality(docs, labels.where("false"), lambda c: c > 0).where("score <> 0.5").count() == 0
    assert quality.quality(docs.where("false"), labels, lambda c: c > 0).count() == 0


def scalar_ppm(train, text, order):
    """The model as plain loops over dictionaries."""
    seen = {}
    for t in train:
        a = bytes([255]) * order + t + bytes([255])
        for i in range(order, len(a)):
            for k in range(order + 1):
                c = seen.setdefault(a[i - k : i], {})
                c[a[i]] = c.get(a[i], 0) + 1
    a, total = bytes([255]) * order + text + bytes([255]), 0.0
    for i in range(order, len(a)):
        gone = set()
        for k in range(order, -1, -1):
            c = {s: n for s, n in seen.get(a[i - k : i], {}).items() if s not in gone}
            if not c:
                continue
            n = sum(c.values())
            if a[i] in c:
                total += math.log10((2 * c[a[i]] - 1) / (2 * n))
                break
            total += math.log10(len(c) / (2 * n))
            gone |= c.keys()
        else:
            total -= math.log10(256 - len(gone))
    return total


@pytest.mark.parametrize("order", [2, 5])
def test_ppm_equals_loops(spark, order):
    rows = corpus(6) + [(900, None, None, None, None), (901, "", None, None, None), (902, "Zq\x01é and Z", None, None, None), (3, "the the", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = ppm.scores(docs, docs.where("doc_id % 7 <> 2"), order=order, common=5).collect()
    train = [(r[1] or "").lower().encode() for r in rows if r[0] % 7 != 2]
    words = [w for t in train for w in [*t.split(), b""]]
    n, v = len(words), len(set(words))
    want = []
    for r in rows:
        t = (r[1] or "").encode().lower()
        w = [*t.split(), b""]
        want.append((r[0], len(w), sum(x in words for x in w), n, round(sum(math.log10((words.count(x) + 1) / (n + v + 1)) for x in w), 6), round(scalar_ppm(train, t, order), 4)))
    assert sorted((r.id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 4)) for r in got) == sorted(want)


def test_ppm_probabilities_add_up_in_any_context():
    c, _ = ppm.grams([EN.encode(), DE.encode()], 3)
    edges, seen = [], []
    for k in range(4):
        u, n = np.unique(c & ppm._mask(k + 1), return_counts=True)
        edges.append(u)
        seen.append(n.astype(float))
    model = ppm.Trie.build(3, edges, seen)
    for ctx in (b"the", b"qqq", b"xth", b"\xff\xff\xff"):
        codes = np.array([int.from_bytes(ctx + bytes([b]), "big") for b in range(256)], np.uint64)
        assert abs((10 ** model.log10(codes)).sum() - 1) < 1e-9


def test_ppm_without_training_rows_and_pruned(spark):
    docs = spark.createDataFrame(corpus(3), SCHEMA)
    got = ppm.scores(docs, docs.where("false")).collect()
    assert all(r.n_known == 0 and abs(r.score + (len(t) + 1) * math.log10(256)) < 1e-6 for r, t in zip(sorted(got), [x[1] for x in corpus(3)]))
    small = ppm.scores(docs, docs, order=3, most=300).agg(F.sum("score")).first()[0]
    assert small < ppm.scores(docs, docs, order=3).agg(F.sum("score")).first()[0]
    assert ppm.scores(docs.where("false"), docs).count() == 0


def test_ppm_keeps_every_context_of_a_large_model(spark):
    """More than 2,000,000 edges, dealt to several tasks and asked for by several chunks, score as one model that holds them all."""
    rng = np.random.default_rng(7)
    texts = [bytes(rng.integers(97, 123, 50_000, np.uint8)) for _ in range(20)]
    codes, begin = ppm.grams(texts, 5)
    levels = [np.unique(codes & ppm._mask(k + 1), return_counts=True) for k in range(6)]
    assert sum(len(u) for u, _ in levels) > 2_000_000
    model = ppm.Trie.build(5, [u for u, _ in levels], [n.astype(float) for _, n in levels])
    want = np.add.reduceat(model.log10(codes), begin)
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r.score for r in sorted(ppm.scores(docs, docs).collect())]
    assert np.abs(np.array(got) - want).max() < 1e-3


def test_ppm_keys_are_codes_rearranged():
    for order in range(1, 7):
        codes = ppm.grams([EN.encode(), DE.encode(), b""], order)[0]
        keys = np.unique(ppm._keys(codes, order))
        assert (ppm._codes(keys, order) != 0).all() and set(ppm._codes(keys, order).tolist()) == set(codes.tolist())
        parts = list(ppm._dealt(keys, order))
        assert sum(s.stop - s.start for _, s in parts) == len(keys) and len({b for b, _ in parts}) == len(parts)


def test_ppm_finds_strings_without_sorting_them_again():
    rng = np.random.default_rng(7)
    for n in (1, 5, 3_000):
        keys = ppm._distinct(np.concatenate([rng.integers(0, 1 << 48, n), np.arange(n)]).astype(np.uint64))
        asked = rng.choice(keys, 10_000)
        places = ppm.Places(keys)
        assert (places.of(asked) == np.searchsorted(keys, asked)).all() and len(places.of(asked[:0])) == 0
        with pytest.raises(KeyError):
            places.of(np.array([1 << 50], np.uint64))
    at_once = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)) * np.arange(1, 500, dtype=np.uint64)  # all begin in the same slot
    assert (ppm.Places(at_once).of(at_once[::-1]) == np.arange(499)[::-1]).all()
    x, n = rng.integers(0, 50, 1_000).astype(np.uint64), np.full(1_000, 1 << 31, np.uint32)
    for part in (0, 1, 1_000):
        unique, sums = ppm._summed(x[:part], n[:part])
        want, counts = np.unique(x[:part], return_counts=True)
        assert (unique == want).all() and (ppm._distinct(x[:part]) == want).all() and (sums == counts * float(1 << 31)).all()


def test_remainder_is_that_of_crc32(spark):
    from corbel.llm.common import id_remainder

    got = spark.range(50).select("id", id_remainder(F.col("id"), 7).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 7 for r in got)


def test_language_features_and_votes_by_hand(spark):
    """Every n-gram counted one by one; every pair of a family votes once; all languages with a label are learned, however many."""
    from corbel.llm import language as L

    text = "Ça va, Élise? x"
    raw = b" " + b" ".join(text.lower().encode().translate(L._BLANK).split()) + b" "
    counts = np.zeros(L.DIMS)
    for n in range(1, 5):
        for i in range(len(raw) - n + 1):
            counts[(int.from_bytes(raw[i : i + n], "big") * 2654435761 + n * 40503) % 2**32 >> 21] += 1
    assert np.allclose(L.features(text), np.sqrt(counts / counts.sum()), atol=1e-6)
    rng = np.random.default_rng(5)
    langs = ["de", "nl", "sv", "fr", "it"]
    seeds = {g: rng.random(L.DIMS).astype(np.float32) for g in langs}
    model = L.fit([(g, seeds[g] + 0.05 * rng.random(L.DIMS).astype(np.float32)) for g in langs for _ in range(30)])
    x = np.array([seeds[g] for g in langs], np.float32)
    got = model.predict(x)
    for row, (lang, family, score) in zip(x, got):
        one = np.append(row, 1)
        margins = [float(one @ model.weights[:, k]) for k in range(len(model.families))]
        assert family == model.families[int(np.argmax(margins))]
        own, pairs, w = model.within[family]
        votes = dict.fromkeys(own, 0.0)
        for k, (a, b) in enumerate(pairs):
            p = 1 / (1 + np.exp(-3 * float(one @ w[:, k])))
            votes[own[a]] += p
            votes[own[b]] += 1 - p
        assert lang == max(own, key=lambda g: votes[g]) and 0 <= score <= 1
    assert [g[0] for g in got] == langs
    rows = [(k * 1000 + i, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 20, f"l{k}") for k in range(230) for i in range(2)]
    learned = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(learned.families) == 230


def plain_languages(train, texts, cost=20.0, steps=150):
    """The method in one process and 64 bits: features, families, pairs of languages in a family, votes."""

    def vector(t):
        if not t or not any(c.isalpha() for c in t):
            return None
        data = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in t.lower().encode())
        data, counts = b" " + b" ".join(data.split()) + b" ", {}
        for n in range(1, 5):
            for i in range(len(data) - n + 1):
                slot = ((int.from_bytes(data[i : i + n], "big") * 2654435761 + n * 40503) % 2**32) >> 21
                counts[slot] = counts.get(slot, 0) + 1
        out = np.zeros(language.DIMS + 1)
        for k, c in counts.items():
            out[k] = np.sqrt(c / sum(counts.values()))
        out[-1] = 1
        return out

    def machine(x, y):
        rate, w = 1 / (1 + 2 * cost * (x * x).sum(1).mean()), np.zeros(x.shape[1])
        v = w
        for k in range(steps):
            new = v - rate * (v - 2 * cost / len(x) * (x.T @ (y * np.maximum(0, 1 - y * (x @ v)))))
            w, v = new, new + k / (k + 3) * (new - w)
        return w

    rows = [(g, v) for g, t in train if g is not None and (v := vector(t)) is not None]
    x, of, chance = np.array([v for _, v in rows]), np.array([g for g, _ in rows]), lambda m: 1 / (1 + np.exp(-3 * m))
    kin = np.array([language.family(g) for g in of])
    families = sorted(set(kin))
    first = {f: machine(x, np.where(kin == f, 1.0, -1.0)) for f in families}
    langs = {f: sorted(set(of[kin == f])) for f in families}
    second = {(a, b): machine(x[(of == a) | (of == b)], np.where(of[(of == a) | (of == b)] == a, 1.0, -1.0)) for f in families for i, a in enumerate(langs[f]) for b in langs[f][i + 1 :]}
    out = []
    for t in texts:
        if (v := vector(t)) is None:
            out.append(("und", 0.0))
            continue
        votes = {f: chance(v @ first[f]) for f in families}
        best = max(families, key=lambda f: votes[f])
        own = {g: sum(chance(v @ w) if a == g else 1 - chance(v @ w) for (a, b), w in second.items() if g in (a, b)) for g in langs[best]}
        top = max(langs[best], key=lambda g: own[g])
        share = (own[top] / sum(own.values()) if len(own) > 2 else own[top]) if len(own) > 1 else 1.0
        out.append((top, share * (votes[best] / sum(votes.values()) if len(families) > 1 else 1.0)))
    return out


def test_language_query_equals_the_method_in_one_process(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    want = plain_languages([(d.lang, d.text) for d in docs if not held(d.doc_id)], [d.text for d in docs])
    got = {r.doc_id: r for r in queries.op2_language(spark, folder).collect()}
    assert len(got) == len(docs)
    for d, (lang, score) in zip(docs, want):
        r = got[d.doc_id]
        assert (r.lang_pred, r.held_out) == (lang, held(d.doc_id)) and abs(r.score - score) < 2e-3
