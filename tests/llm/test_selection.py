import hashlib
import math
import random
import re

import pytest

from corbel.llm import decontaminate, linededup, mixing, search

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string"


def frame(spark, rows, source=lambda i: "s"):
    return spark.createDataFrame([(i, t, "en", source(i), 0, "clash") for i, t in rows], DOCS)


# decontamination
def brute_hits(docs, items, size=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for item, t in items:
        w = cut(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    out = []
    for doc, t in docs:
        w, hit, found = cut(t), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    found |= wins[tuple(w[i : i + k])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def decontamination_rows():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)] + ["Äb", "é9"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice((0, 3, 13, 14, 30))))) for k in range(12)] + [(90, None), (91, "!!"), (3, "w1 w2"), (92, "solo")]
    docs = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.randrange(0, 120))]
        if i % 3 == 0:
            w[5:5] = (rng.choice(items)[1] or "").split()
        docs.append((i, ", ".join(w).upper() if i % 2 else "-".join(w)))
    return docs + [(900, None), (901, ""), (902, "w1-W2"), (0, "solo solo"), (903, "w1 " * 20_000)], items


@pytest.mark.parametrize("block", [100_000, 7])
def test_decontamination_equals_brute_force(spark, block):
    docs, items = decontamination_rows()
    got = decontaminate.report(frame(spark, docs), spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, source string"), block=block)
    assert sorted(map(tuple, got.collect()), key=str) == brute_hits(docs, items)


def test_decontamination_of_empty_tables(spark):
    docs, items = decontamination_rows()
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(frame(spark, docs), none).where("n_hit > 0").count() == 0
    assert decontaminate.report(frame(spark, []), none).count() == 0


# lines
def edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def brute_lines(docs):
    bare = lambda x: x.strip(" \t\r")
    first = {}
    for doc, text in sorted((d for d in docs if d[1] is not None), key=lambda d: d[0]):
        for x in text.split("\n"):
            if bare(x):
                first.setdefault(bare(x), (len(first), doc))
    order = list(first)
    near = {b for k, b in enumerate(order) if len(b) >= 20 and any(len(a) >= 20 and edits(a, b) <= 1 for a in order[:k])}
    out, used = {}, set()
    for doc, text in sorted((d for d in docs if d[1] is not None), key=lambda d: d[0]):
        kept = []
        for x in text.split("\n"):
            if not bare(x):
                kept.append(x)
            elif bare(x) not in used:
                used.add(bare(x))
                if bare(x) not in near:
                    kept.append(x)
        out[doc] = "\n".join(kept)
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abé ") for _ in range(rng.randrange(15, 90))) for _ in range(25)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(rng.randrange(0, 9)):
            x = list(rng.choice(pool))
            for _ in range(rng.randrange(0, 3)):
                k = rng.randrange(len(x))
                x[k : k + rng.randrange(0, 2)] = rng.choice(("", "z", "é"))
            lines.append(rng.choice(("", " ", "\t")) + "".join(x) + rng.choice(("", "\r")))
        docs.append((i, "\n".join(lines)))
    docs += [(900, None), (901, ""), (902, "\n\n"), (903, "x" * 5_000 + "\nshort\nshort"), (904, "x" * 4_999)]
    got = {r.doc_id: r for r in linededup.dedup_lines(frame(spark, docs)).collect()}
    want = brute_lines(docs)
    assert {i: r.text for i, r in got.items() if i != 900} == want
    assert got[900].text is None and got[900].n_lines == 0 and len(got) == len(docs)
    assert all(r.n_lines == len(t.split("\n")) for i, t in docs if t is not None for r in [got[i]])


def test_lines_of_repeated_rows_and_empty_tables(spark):
    got = linededup.dedup_lines(frame(spark, [(1, "a line that is long enough\nb"), (1, "a line that is long enough\nb"), (None, "b")])).collect()
    assert sorted((str(r.doc_id), r.n_kept) for r in got) == [("1", 2), ("1", 2), ("None", 0)]
    assert linededup.dedup_lines(frame(spark, [])).count() == 0


# mixing
def test_lines_of_distant_null_and_repeated_ids_and_a_very_long_document(spark):
    """Ids that leave no room for a place in 63 bits; rows with equal ids and different texts; 100,000 lines in a document, in bounded time."""
    some = "the first line of many letters\nshort\na line that nobody else has got"
    docs = [(-(2**62), some), (2**62, "the first line of many letterz\nshort\nown"), (2**62, "own\nanother text with the same id"), (None, "short\nlast")]
    for rows in (docs, [(None if i is None else int(i > 0), t) for i, t in docs]):
        got = {(r.text, r.n_lines, r.n_kept) for r in linededup.dedup_lines(frame(spark, rows)).collect()}
        assert got == {(some, 3, 3), ("", 3, 0), ("own\nanother text with the same id", 2, 2), ("last", 2, 1)}
    long_ = "\n".join(f"line {k // 2}" for k in range(100_000))
    r = linededup.dedup_lines(frame(spark, [(1, long_)])).collect()[0]
    assert (r.n_lines, r.n_kept) == (100_000, 50_000) and r.text == "\n".join(f"line {k}" for k in range(50_000))


def test_targets_by_repeated_sharing(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 500, "d": 5, None: 7}, {"a": 0, "b": 3}, {"x": 9}, {f"s{k:02}": (k * 37) % 91 + 1 for k in range(30)}):
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
        left, open_, want = float(sum(sizes.values())), set(names), {}
        while open_:
            share = left / sum(weight[s] for s in open_)
            over = {s for s in open_ if weight[s] * share > 3 * sizes[s]}
            if not over:
                want |= {s: weight[s] * share for s in open_}
                break
            want |= {s: 3.0 * sizes[s] for s in over}
            left -= sum(3 * sizes[s] for s in over)
            open_ -= over
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in want)


def test_mixture_meets_targets_and_agrees_when_run_again(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40))) for i in range(3_000)] + [(9001, None), (9002, " "), (9003, "w " * 3)]
    docs = frame(spark, rows, lambda i: None if i % 10 == 9 else f"s{min(i % 10, 4)}")
    got = mixing.mixture(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 3 for r in got)
    source = {i: None if i % 10 == 9 else f"s{min(i % 10, 4)}" for i, _ in rows}
    taken, target = {}, {}
    for r in got:
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.copies * r.size
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)
    again = mixing.mixture(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_inclusion_follows_the_documents_own_chances(spark):
    """200 sources of equal sizes: how often a document is drawn follows its size, and the longest is certain."""
    sizes = [1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 60]
    rows = [(k * 100 + j, "w " * n) for k in range(200) for j, n in enumerate(sizes)]
    got = mixing.mixture(frame(spark, rows, lambda i: f"s{i // 100:03d}"), weights=(1,), share=0.7).collect()
    rest, top = 0.7 * sum(sizes), [n for n in sizes if n < 60]
    rate = (rest - 60) / sum(n * n for n in top)
    assert rate * 16 < 1 and all(abs(r.target - rest) < 1e-6 and r.copies <= 1 for r in got)
    for n in sizes:
        drawn = [r.copies for r in got if r.size == n]
        want = min(1, rate * n)
        assert len(drawn) == 200 and abs(sum(drawn) / 200 - want) <= 0.02 + 3.5 * (want * (1 - want) / 200) ** 0.5


def test_mixture_of_one_huge_document_or_nothing(spark):
    got = mixing.mixture(frame(spark, [(1, "w " * 50_000), (2, "a b"), (2, "a b")], lambda i: f"s{i}")).collect()
    assert len(got) == 3 and all(r.copies <= 3 for r in got)
    assert mixing.mixture(frame(spark, [])).count() == 0
    assert mixing.mixture(frame(spark, [(1, ""), (2, None)])).where("copies > 0").count() == 0


# search
def brute_bm25(docs, queries, k):
    cut = lambda t: decontaminate.words((t or "").encode())
    words = [(i, cut(t)) for i, t in docs]
    n, mean = len(words), sum(len(w) for _, w in words) / len(words)
    df = {}
    for _, w in words:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for q, t in queries:
        terms, found = set(cut(t)), []
        for i, w in words:
            s = sum(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x in terms if x in w)
            if s > 0:
                found.append((-round(s, 9), i))
        out += [(q, i, round(-s, 6), r) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("more", [{}, {"shard_bytes": 4_000}, {"block_bytes": 900, "shard_bytes": 20_000}])
def test_search_equals_brute_force(spark, more):
    rng = random.Random(6)
    words = [f"t{int(rng.paretovariate(0.6))}" for _ in range(4_000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 80)))) for i in range(400)]
    docs += [(900, None), (901, ""), (902, docs[0][1]), (903, docs[0][1]), (904, "t1 " * 3_000)]
    queries = [d for d in docs if d[0] % 10 == 0] + [(77, "nothing known"), (78, "t1 t1 t2")]
    got = search.top_k(frame(spark, docs), frame(spark, queries), k=5, **more).collect()
    assert sorted((r.query_id, r.doc_id, round(r.score, 6), r.rank) for r in got) == brute_bm25(docs, queries, 5)


def test_search_of_empty_tables(spark):
    some, none = frame(spark, [(1, "a")]), frame(spark, [])
    assert search.top_k(none, some).count() == 0 and search.top_k(some, none).count() == 0


def test_search_with_null_ids_clashing_columns_and_ties(spark):
    docs = [(5, "red apple"), (None, "red apple"), (3, "red apple"), (None, "green pear tree"), (9, "pear " * 4_000), (3, "red apple")]
    asked = [(1, "apple"), (None, "pear"), (2, "pear tree")]
    got = sorted(((r.query_id, r["rank"], r.doc_id) for r in search.top_k(frame(spark, docs), frame(spark, asked), k=4).collect()), key=repr)
    assert got == sorted([(1, 1, 3), (1, 2, 3), (1, 3, 5), (1, 4, None), (2, 1, None), (2, 2, 9)], key=repr)


def test_search_scores_few_documents(spark):
    """Pivots end the search: of a shard's documents only a part is scored in full, and the result is that of scoring all."""
    import numpy as np

    rng = np.random.default_rng(3)
    n, terms = 3_000, 600
    lists = [np.unique(rng.integers(0, n, int(n / (1 + t / 6)) + 2)).astype(np.int32) for t in range(terms)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    docs = np.concatenate(lists)
    tfs = rng.integers(1, 6, len(docs)).astype(np.int32)
    row = {"lengths": rng.integers(50, 400, n), "terms": np.arange(terms), "offsets": offsets, "docs": docs, "tfs": tfs}
    shard = search.Shard(row, 200.0, 1.2, 0.75)
    df = np.diff(offsets)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    queries = [(np.sort(rng.choice(terms, 40, replace=False)), None) for _ in range(300)]
    queries = [(t, idf[t]) for t, _ in queries]
    least = np.full(len(queries), -np.inf)
    for (t, w), (found, scores) in zip(queries, shard.search(queries, 10, least)):
        full = np.zeros(n)
        for x, i in zip(t, w):
            at = slice(offsets[x], offsets[x + 1])
            full[docs[at]] += shard.weights[at] * i
        best = np.sort(full)[::-1][:10]
        assert np.allclose(np.sort(scores)[::-1][:10], best) and np.allclose(full[found], scores)
    assert shard.scored < 0.35 * n * len(queries)
    before = shard.scored
    list(shard.search(queries, 10, np.full(len(queries), 1e9)))  # what can't reach the k-th score of other shards isn't scored at all
    assert shard.scored == before


def test_search_deals_rows_without_ids_to_many_shards(spark):
    rng = random.Random(5)
    docs = [(None if i % 2 else i, " ".join(rng.choice("abcdefghij") * 3 for _ in range(30)) + f" x{i}") for i in range(400)]
    shards = search.build(frame(spark, docs), "doc_id", "text", 2_000).collect()
    sizes = [len(r["ids"]) for r in shards]
    assert sum(sizes) == 400 and len(sizes) > 8 and max(sizes) < 4 * sum(sizes) / len(sizes)
