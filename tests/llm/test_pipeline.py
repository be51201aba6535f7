import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_stages_keep_columns_and_their_decisions_hold(spark):
    import corpus_pipeline as C
    from corbel.llm import decontaminate, simhash
    from corbel.llm.common import stable, table

    docs = table(spark, SF, "documents")
    before = docs.columns
    kept = [docs.count()]
    for name, stage in C.STAGES[:4]:
        docs = stable(stage(spark, docs, SF))
        assert docs.columns == before, name
        kept.append(docs.count())
        if name == "near_duplicates":
            assert simhash.duplicate_groups(docs).where("doc_id <> group_id").count() == 0
        if name == "decontamination":
            assert decontaminate.report(docs, table(spark, SF, "benchmark")).where("contaminated").count() == 0
    assert kept[0] > kept[1] >= kept[2] >= kept[3] > 0
    out = stable(C.STAGES[4][1](spark, docs, SF))
    assert out.count() == kept[4] and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    starts = sorted((r.start, r.n_tokens) for r in out.collect())
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_clean_documents_stay(spark):
    import corpus_pipeline as C
    from corbel.llm.common import table

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kept = C.STAGES[0][1](spark, docs, SF)
    good, bad = (labels.where(f"quality = {q}").select("doc_id") for q in (1, 0))
    assert kept.join(good, "doc_id").count() >= 0.97 * docs.join(good, "doc_id").count()
    assert kept.join(bad, "doc_id").count() <= 0.3 * docs.join(bad, "doc_id").count()


def tables(spark, folder, docs, labels=(), items=()):
    columns = "doc_id long, text string, lang string, source string, n_chars long, _text string, id string, _name string"
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "own", "clash", "clash") for i, t in docs], columns)
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    return docs


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages_drop_rows_and_not_ids(spark, tmp_path):
    """Ids repeat and are null, columns clash with the stages' own; what is dropped is dropped by its own text."""
    import corpus_pipeline as C

    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    item = " ".join(f"q{k}" for k in range(13))
    given = [(3, a), (5, a), (5, b), (5, b), (None, a), (None, "kept for its own text"), (7, None), (8, ""), (8, " \n"), (1, f"x {item}"), (1, "clean text of the same id"), (None, f"{item} y"), (9, item.upper())]
    docs = tables(spark, str(tmp_path), given, items=[(1, item), (2, None), (3, "")])
    got = C.drop_near_duplicates(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert rows(got) == sorted([(3, a), (5, b), (None, "kept for its own text"), (7, None), *given[9:11]], key=repr)
    got = C.drop_contaminated(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and rows(got) == sorted((g for g in given if "q5" not in (g[1] or "").lower()), key=repr)
    good, bad = "A fine sentence, with words of some length and an end. ", "$$$ ### ??? 1 2 3 $$$ %%% "
    many = [(i, (good if i % 2 else bad) * (3 + i % 5)) for i in range(200)]
    docs = tables(spark, str(tmp_path), many + [(1, bad * 4), (None, good * 4), (None, bad * 4), (500, None), (501, "")], labels=[(i, i % 2, 0) for i in range(2, 200)])
    kept = rows(C.drop_low_quality(spark, docs, str(tmp_path)))
    assert (None, good * 4) in kept and (None, bad * 4) not in kept and (1, bad * 4) not in kept and (1, good * 4) in kept
    assert {i for i, _ in kept if i is not None and i < 200} == set(range(1, 200, 2))
    docs = tables(spark, str(tmp_path), [])
    for name, stage in C.STAGES[:4]:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
    assert C.STAGES[4][1](spark, docs, str(tmp_path)).count() == 0
    docs = tables(spark, str(tmp_path), given)
    assert C.drop_low_quality(spark, docs, str(tmp_path)).count() == len(given)  # without labels all stay
    mixed = C.mix_sources(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns
    tokens = C.token_files(spark, docs, str(tmp_path)).collect()
    assert len(tokens) == len(given) and sum(r.n_tokens == 1 for r in tokens) == 3


def brute_quality(spark, docs, labels):
    """The classifier in one process: statistics, random features, ridge over two thirds, isotonic steps over the rest."""
    import numpy as np
    from pyspark.sql import functions as F

    from corbel.llm.quality import pool_adjacent
    from corbel.llm.textstats import stats

    ids = [i for i, _ in docs]
    third = {r.i: r.k for r in spark.createDataFrame([(i,) for i in ids], "i long" if isinstance(ids[0], int) else "i string").select("i", F.pmod(F.xxhash64("i", F.lit(5)), F.lit(3)).alias("k")).collect()}
    x = np.array([np.nan_to_num(np.array(stats((t or "").encode()), np.float32)) for _, t in docs], np.float64)
    at = [k for k, i in enumerate(ids) if labels.get(i) is not None]
    y = np.array([labels[ids[k]] for k in at], float)
    mean, scale = x[at].mean(0), np.sqrt(np.maximum((x[at] ** 2).mean(0) - x[at].mean(0) ** 2, 1e-6))
    rng = np.random.default_rng(11)
    freq, phase = rng.normal(0, np.sqrt(0.06), (x.shape[1], 256)), rng.uniform(0, 2 * np.pi, 256)
    z = np.hstack([np.ones((len(x), 1)), np.cos(np.clip((x - mean) / scale, -6, 6) @ freq + phase) * np.sqrt(2 / 256)])
    fold = np.array([third[ids[k]] != 0 for k in at])
    a, t = z[at][fold], y[fold]
    w = np.linalg.solve(a.T @ a + 1e-3 * len(at) / 257 * np.eye(257), a.T @ t)
    raw = z @ w
    cell = np.clip(np.round(raw[at][~fold] * 200), -400, 600)
    knots = np.unique(cell)
    steps = pool_adjacent(np.array([y[~fold][cell == c].sum() for c in knots]), np.array([(cell == c).sum() for c in knots], float))
    return dict(zip(ids, np.clip(np.interp(raw, knots / 200, steps), 0, 1)))


def test_quality_query_equals_one_process(spark):
    import zlib

    from corbel.llm import queries
    from corbel.llm.common import table

    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    want = brute_quality(spark, docs, labels)
    got = {r.doc_id: r.score for r in queries.op6_quality(spark, SF).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 2e-2 and sum(abs(got[i] - want[i]) > 1e-6 for i in got) <= len(got) // 50


def test_whole_run_equals_brute_force(spark):
    """Every stage again, in plain Python, on its own input; the run is the last one's result."""
    import hashlib
    import re
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as C
    from corbel.llm import simhash
    from corbel.llm.common import table

    docs = [(r.doc_id, r.text or "", r.source) for r in table(spark, SF, "documents").collect()]
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect() if r.quality is not None}
    first = {r.doc_id for r in C.drop_low_quality(spark, table(spark, SF, "documents"), SF).collect()}
    key = lambda t: hashlib.md5(t.encode()).hexdigest()
    said: dict[str, set] = {}
    for i, t, _ in docs:
        said.setdefault(key(t), set()).update({labels[i]} if i in labels else ())
    score = brute_quality(spark, list({key(t): t for _, t, _ in docs}.items()), {k: min(x) for k, x in said.items() if len(x) == 1})
    assert all((i in first) == (score[key(t)] >= 0.3) for i, t, _ in docs if abs(score[key(t)] - 0.3) > 1e-6)
    docs = [d for d in docs if d[0] in first]
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5).tolist()) for i, t, _ in docs}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    docs = [d for d in docs if find(d[0]) == d[0]]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = cut(r.text or "")
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()

    def contaminated(t):
        w, hit = cut(t), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
        return bool(hit) and 20 * len(hit) >= len(w)

    docs = [d for d in docs if not contaminated(d[1])]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in docs}
    sources = sorted({s for *_, s in docs})
    total = {s: sum(size[i] for i, _, x in docs if x == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), float(sum(total.values()))
    while True:
        full = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) >= 3 * total[s]}
        if not full:
            target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        target |= {s: 3.0 * total[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
        if not open_:
            break
    copies = {}
    for s in sources:
        own = [i for i, _, x in docs if x == s]
        whole = int(target[s] // total[s]) if total[s] else 0
        rest = target[s] - whole * total[s]
        copies |= {i: whole for i in own}
        if rest <= 0:
            continue
        top = max(n for n in {size[i] for i in own if size[i]} if (rest - sum(size[i] for i in own if size[i] > n)) * n <= sum(size[i] ** 2 for i in own if size[i] <= n))
        rate = (rest - sum(size[i] for i in own if size[i] > top)) / sum(size[i] ** 2 for i in own if size[i] <= top)

        def odds(i):
            u = (int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            pi = rate * size[i]
            return 0.0 if size[i] > top or pi >= 1 else u / (1 - u) / (pi / (1 - pi))

        taken = 0
        for i in sorted((i for i in own if size[i]), key=lambda i: (odds(i), str(i), size[i])):
            if taken + size[i] <= rest or (taken < rest and taken + size[i] - rest < rest - taken):
                copies[i] += 1
            taken += size[i]
    texts = dict((i, t) for i, t, _ in docs)
    real, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for i in sorted(copies):
        code = [*real.encode(texts[i], add_special_tokens=False).ids, 1]
        for _ in range(copies[i]):
            want.append((i, start, len(code), zlib.crc32(np.array(code, "<u4").tobytes())))
            start += len(code)
    assert sorted(map(tuple, C.run(spark, SF).collect())) == sorted(want)
