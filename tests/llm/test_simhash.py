import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corbel.llm import simhash as S
from corbel.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, component_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in rows], DOCS)


def groups(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def texts(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    out = []
    for i in range(n):
        if i % 3 == 0 or not out:
            out.append([rng.choice(words) for _ in range(rng.randrange(30, 300))])
        else:
            base = list(rng.choice(out))
            for _ in range(rng.randrange(0, 4)):
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append(base)
    return [" ".join(x) for x in out]


def test_fingerprint_is_the_majority_of_shingle_hashes():
    text = "A b  C\td e"
    w = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > 3)
    assert S.fingerprint(S.shingle_hashes(text.encode(), 3)) == want
    assert S.fingerprint(S.shingle_hashes(b"One two", 3)) == xxhash.xxh64_intdigest("one two", 42)
    assert S.fingerprint(S.shingle_hashes(b" \n", 3)) == 0


def test_components_equal_brute_force_with_nulls_blanks_repeats_and_other_columns(spark):
    rows = list(enumerate(texts(240))) + [(900, None), (901, ""), (902, " \n"), (903, "ab"), (904, "AB"), (7, "ab"), (905, "x " * 20_000)]
    got = S.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    fp = {}
    for i, t in rows:
        fp.setdefault(f"{S.fingerprint(S.shingle_hashes((t or '').encode(), 3)):016x}", []).append(i)
    keys = sorted(fp)
    near = [(a, b) for k, a in enumerate(keys) for b in keys[k + 1 :] if bin(int(a, 16) ^ int(b, 16)).count("1") <= 3]
    comp = groups(near, keys)
    low = {}
    for k in keys:
        low[comp[k]] = min(low.get(comp[k], 10**9), *fp[k])
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, k, low[comp[k]]) for k in keys for i in fp[k])


def test_empty_table(spark):
    assert S.near_duplicates(frame(spark, [])).count() == 0
    assert S.duplicate_groups(frame(spark, [])).count() == 0


def test_points_in_small_cells_and_shards_give_the_same_links(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    pts = np.unique(np.concatenate([base, *(base ^ (np.int64(1) << rng.integers(0, 62, 40)) for _ in range(6))]))
    df = spark.createDataFrame([(int(x), [int(x)], 1) for x in pts], "id long, fp array<long>, size long").persist()
    want = groups([(int(a), int(b)) for k, a in enumerate(pts) for b in pts[k + 1 :] if bin(int(a) ^ int(b)).count("1") <= 3], [int(x) for x in pts])
    for more in ({}, {"cell": 7}, {"shards": 8, "sample": 100}):
        links = S.near_links(df, 3, **more).collect()
        assert groups([(r.u, r.v) for r in links], [int(x) for x in pts]) == want
        assert len(links) < 60 * len(pts)


def test_duplicate_groups_equal_brute_force(spark):
    rows = list(enumerate(texts(200, 5))) + [(900, None), (901, ""), (902, "one two"), (903, "One  two")]
    got = {r.doc_id: r.group_id for r in S.duplicate_groups(frame(spark, rows)).collect()}
    sets = {i: set(S.shingle_hashes((t or "").encode(), 5).tolist()) for i, t in rows}
    ids = list(sets)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert got == groups(near, ids)


def test_components_of_a_long_chain(spark):
    chain = [(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hot_group_makes_no_pairs(spark):
    rows = [(i, "the same words again and again in this text") for i in range(500)]
    out = S.near_duplicates(frame(spark, rows))
    assert out.where(F.col("component_id") == 0).count() == 500


def test_groups_of_repeated_ids(spark):
    """An id with two texts is the smallest of both; a row is repeated whole. Each text keeps one row, and no row is lost."""
    import corpus_pipeline as C

    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (3, b), (4, b), (5, c), (5, c), (6, a + " more"), (7, c), (4, "alone in its group")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.group_id) for r in S.duplicate_groups(docs).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1), (4, 4), (5, 5), (5, 5), (6, 1), (7, 5)]
    kept = sorted(tuple(r) for r in C.drop_near_duplicates(spark, docs, "").collect())
    assert kept == [(1, a), (1, b), (4, "alone in its group"), (5, c)]


def test_large_components_are_cut_into_cells(spark, monkeypatch):
    """A cluster of near copies beyond a cell's size: one is compared with all, the rest in cells; null ids name no group of others."""
    rng, base = random.Random(1), [f"z{k}" for k in range(120)]
    rows = list(enumerate(texts(120, 9)))
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(120)] = f"e{i}"
        rows.append((1000 + i, " ".join(w)))
    links = S.similar_links
    monkeypatch.setattr(S, "similar_links", lambda nodes, similarity: links(nodes, similarity, part=1_500))
    extra = [(None, "a text of its own without an id"), (None, " ".join(base)), (None, None), (2000, "")]
    got = [(r.doc_id, r.group_id) for r in S.duplicate_groups(frame(spark, rows + extra)).collect()]
    sets = {i: set(S.shingle_hashes((t or "").encode(), 5).tolist()) for i, t in rows}
    ids = list(sets)
    want = groups([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], ids)
    assert {i: g for i, g in got if i in want} == want
    named = next(want[i] for i, t in rows if t == " ".join(base)) if " ".join(base) in dict(rows).values() else want[1000]
    assert sorted((x for x in got if x[0] not in want), key=repr) == sorted([(None, None), (None, named), (None, 2000), (2000, 2000)], key=repr)


def test_short_texts_lose_no_link(spark):
    """Texts of 5 to 12 words with a word put before or behind: similar by their sets, though their SimHashes lie far apart."""
    rng = random.Random(8)
    rows = []
    for i in range(0, 400, 2):
        w = [f"t{rng.randrange(10**6)}" for _ in range(rng.randrange(8, 13))]
        rows += [(i, " ".join(w)), (i + 1, " ".join([*w, "more"] if i % 4 else ["more", *w]))]
    got = {r.doc_id: r.group_id for r in S.duplicate_groups(frame(spark, rows)).collect()}
    sets = {i: set(S.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}
    for i in range(0, 400, 2):
        near = len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])
        assert (got[i + 1] == i) == near and got[i] == i
    assert any(bin(S.fingerprint(S.shingle_hashes(rows[i][1].encode(), 5)) ^ S.fingerprint(S.shingle_hashes(rows[i + 1][1].encode(), 5))).count("1") > 17 for i in range(0, 400, 2) if got[i + 1] == i)


def test_prefix_links_connect_all_similar_texts_also_where_a_shingle_is_frequent(spark):
    rows = texts(150, 4)
    base = [f"z{k}" for k in range(100)]
    rows += [" ".join(base[:50] + [f"e{i}"] + base[51:]) for i in range(40)]
    sets = [S.shingle_hashes(t.encode(), 5) for t in rows]
    data = [(i, int(np.uint64(S.fingerprint(np.unique(h))).view(np.int64)), len(np.unique(h)), np.unique(h).view(np.int64).tolist()) for i, h in enumerate(sets)]
    df = spark.createDataFrame(data, "node long, fp long, size long, hashes array<long>").persist()
    whole = [set(h.tolist()) for h in sets]
    near = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if len(whole[a] & whole[b]) >= 0.8 * len(whole[a] | whole[b])]
    for most in (5, 1024):
        links = [(r.u, r.v) for r in S.prefix_links(df, 0.8, most=most).collect()]
        group = groups(links, range(len(rows)))
        assert all(group[a] == group[b] for a, b in near) and len(links) < 12 * len(rows)


@pytest.mark.parametrize(("low", "high"), [(36, 45), (120, 160), (600, 700)])
def test_bits_lose_no_similar_pair_at_any_length(spark, low, high):
    """Texts with so many words replaced that they are just similar, by length: the default of 25 bits finds what 64 bits, which drop nothing, find."""
    rng, rows = random.Random(low), []
    for i in range(120):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(low, high))]
        edited = list(w)
        for at in rng.sample(range(len(w)), len(w) // 50) or [len(w) - rng.randrange(1, 5)]:  # of a short text one of the last words, which few shingles have
            edited[at] = f"e{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(edited))]
    sets = {i: set(S.shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}
    near = {i for i in range(0, 240, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    far = {i for i in near if bin(S.fingerprint(S.shingle_hashes(rows[i][1].encode(), 5)) ^ S.fingerprint(S.shingle_hashes(rows[i + 1][1].encode(), 5))).count("1") > 3}
    assert len(near) > 20 and len(far) > 15
    for bits in (25, 64):
        got = {r.doc_id: r.group_id for r in S.duplicate_groups(frame(spark, rows), bits=bits).collect()}
        assert {i for i in range(0, 240, 2) if got[i + 1] == got[i]} == near
