"""Ops 9 and 10, components, and the pipeline."""

import random

import numpy as np
import pytest

from scorebook.llm import hilbert_knn, jaccard_join
from scorebook.llm.components import components


def brute_components(texts, size, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts:
        w = (t or "").translate(low).split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    boss = {i: i for i in sets}

    def find(x):
        while boss[x] != x:
            x = boss[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                boss[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    docs, line = [], "all rights reserved by the owner of this text"
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 90))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append(" ".join(w).title() + (" " + line if g % 2 else ""))
    docs += ["", None, "one two", "One TWO", "one two three", line, line]
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(i, docs[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("size,percent,how", [(4, 85, {}), (5, 80, {}), (4, 85, {"leaf_rows": 3, "pivots": 2}), (5, 80, {"leaf_rows": 2, "pivots": 3})])
def test_jaccard_join(spark, corpus, size, percent, how):
    want = brute_components(corpus, size, percent)
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(df, size, percent, **how).collect()}
    assert got == want and any(c != i for i, (_, c) in got.items())


def test_join_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e", 1), (5, "a b c d e", 1), (7, "", 1), (8, None, 1), (5, "a b c d e", 1)], "doc_id long, text string, component_id int")
    got = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard_join.join(df).collect()), key=str)
    assert got == sorted([(-1, 2, 5), (5, 2, 5), (5, 2, 5), (7, 0, 7), (8, 0, 8)], key=str)
    assert jaccard_join.join(df.limit(0)).count() == 0
    assert jaccard_join.one_of_each(df.filter("doc_id IS NOT NULL")).columns == df.columns
    for order in ([(7, "A"), (7, "B"), (9, "C")], [(7, "B"), (7, "A"), (9, "C")]):
        text = {"A": " ".join(f"a{i}" for i in range(60)), "B": " ".join(f"b{i}" for i in range(60)), "C": " ".join(f"b{i}" for i in range(60)) + " and four more words"}
        two = spark.createDataFrame([(i, text[t], 1, "z") for i, t in order], "doc_id long, text string, _id int, region string").coalesce(1)
        assert sorted(tuple(r) for r in jaccard_join.join(two).select("doc_id", "component_id").collect()) == [(7, 7), (7, 7), (9, 7)]
        assert jaccard_join.one_of_each(two).count() == 2


def test_one_of_each_with_null_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*base[:-1], f"x{k}"])
    other = [" ".join(f"{c}{i}" for i in range(50)) for c in "uv"]
    rows = [(None, near(0)), (None, near(1)), (4, near(2)), (5, near(3)), (None, other[0]), (7, other[0] + " more"), (8, other[1]), (9, other[1]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in jaccard_join.one_of_each(df).collect()]
    assert len([t for _, t in kept if t and t.startswith("w0 ")]) == 1 and not {4, 5, 7, 9} & {i for i, _ in kept}
    assert (None, other[0]) in kept and (8, other[1]) in kept and (None, None) in kept and len(kept) == 4
    got = [(r["doc_id"], r["component_id"]) for r in jaccard_join.join(df).collect()]
    assert len(got) == 9 and dict(got)[4] == dict(got)[5] == 4 and dict(got)[7] == 7 and dict(got)[9] == 8


def test_one_of_each_without_words(spark):
    rows = [(None, ""), (None, "..."), (1, ""), (2, None)]
    assert jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).count() == 4


def test_sketches_never_lose_a_link():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(30):
        s = rng.integers(0, 2**63, rng.integers(20, 4000), dtype=np.uint64)
        sets += [np.unique(s), np.unique(np.concatenate([s[len(s) // 12 :], rng.integers(0, 2**63, len(s) // 25, dtype=np.uint64)]))]
    keep = jaccard_join.possible(np.array([len(s) for s in sets]), [jaccard_join.sketch(s) for s in sets], 85)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            n = len(np.intersect1d(a, b))
            if i != j and 100 * n >= 85 * (len(a) + len(b) - n):
                assert keep[i] and keep[j]


def test_close_sets_meet_all_that_may_be_linked():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(12):  # groups of copies, and documents that share two thirds with others
        s = rng.integers(0, 2**63, rng.integers(20, 3000), dtype=np.uint64)
        sets += [np.unique(np.concatenate([s[rng.random(len(s)) < keep], rng.integers(0, 2**63, 5, dtype=np.uint64)])) for keep in (0.99, 0.99, 0.98, 0.8, 0.7)]
    n, sketches = np.array([len(s) for s in sets]), [jaccard_join.sketch(s) for s in sets]
    near = jaccard_join.close(n, sketches, 85)
    assert (near == near.T).all() and not near.diagonal().any()
    assert (near.any(1) == jaccard_join.possible(n, sketches, 85)).all()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            k = len(np.intersect1d(a, b))
            assert i == j or near[i, j] or 100 * k < 85 * (len(a) + len(b) - k)
    for most in (2, 4, 100):
        for matrix in (near, np.ones((20, 20), bool) & ~np.eye(20, dtype=bool), np.triu(rng.random((40, 40)) < 0.1, 1)):
            matrix = matrix | matrix.T
            found = jaccard_join.close_sets(matrix, most)
            assert all(len(x) <= most and len(np.unique(x)) == len(x) for x in found)
            met = np.zeros_like(matrix)
            for x in found:
                met[np.ix_(x, x)] = True
            assert (met | ~matrix).all()
    assert jaccard_join.close_sets(np.zeros((3, 3), bool), 4) == []
    one = jaccard_join.close_sets(np.ones((50, 50), bool) & ~np.eye(50, dtype=bool), 100)
    assert len(one) == 1 and len(one[0]) == 50


@pytest.mark.parametrize("how", [{}, {"leaf_rows": 8, "pivots": 4}])
def test_forms_that_share_sentences(spark, how, monkeypatch):
    """Documents of 40 of the same 50 sentences: nearly none are linked, and no document goes out more than three times."""
    rng, members = random.Random(5), []
    sentences = [" ".join(f"v{rng.randrange(4000)}" for _ in range(20)) for _ in range(50)]
    docs = [". ".join(sentences[k] for k in sorted(rng.sample(range(50), 40))) for _ in range(280)]
    docs += [f"{docs[7]} and some more words here", f"a few words before {docs[7]}", f"{docs[90]} the end"]
    stage = jaccard_join.stage

    def noted(df, name):
        out = stage(df, name)
        if name == "members":
            members.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stage", noted)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(df, **how).collect()}
    assert got == brute_components(list(enumerate(docs)), 4, 85)
    assert got[280][1] == got[281][1] == 7 and got[282][1] == 90 and members[0] <= 3 * len(docs)


def test_meetable_equals_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sizes = rng.integers(1, 9, 5)
        n = np.concatenate([np.sort(rng.integers(5, 40, k)) for k in sizes])
        left = n - rng.integers(0, 6, len(n))
        heads = np.cumsum(sizes) - sizes
        run = np.repeat(np.arange(5), sizes)
        want = [i for i in range(len(n)) if any(i != j and run[i] == run[j] and 185 * min(left[i], left[j]) >= 85 * (n[i] + n[j]) for j in range(len(n)))]
        assert jaccard_join.meetable(heads, n, left, 85).tolist() == want


def test_unlinked_rows_with_a_common_shingle_are_cut_in_few_steps(spark, monkeypatch):
    """A region far above its bound whose rows share a shingle and nothing else, beside a large group of near copies."""
    rng = random.Random(1)
    docs = [(i, "one two three four " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(8))) for i in range(120)]
    base = [f"c{i}" for i in range(80)]
    for i in range(200, 320):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    turns, cut = [], jaccard_join.cut_regions
    monkeypatch.setattr(jaccard_join, "counters_for", lambda chars: 16)  # as in a corpus far larger than the table of counters
    monkeypatch.setattr(jaccard_join, "cut_regions", lambda *a: turns.append(1) or cut(*a))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(df, leaf_rows=8, pivots=4).collect()}
    assert got == {i: c for i, (_, c) in brute_components(docs, 4, 85).items()}
    assert 1 <= len(turns) <= 6


def test_components(spark, as_rows):
    chain = [(i, i + 1) for i in range(10, 40)] + [(3, 99), (99, 50), (7, 7)]
    got = dict(as_rows(components(spark.createDataFrame(chain, "a long, b long"))))
    assert got == {**{i: 10 for i in range(11, 41)}, 99: 3, 50: 3}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hilbert_keys_walk_to_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    keys = hilbert_knn.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()  # the curve moves to an adjacent cell each time


def brute_nearest(rows, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    ids = np.array(sorted(ok))
    x = np.stack([ok[i] for i in ids])
    out = {}
    for i in ids[ids % 20 == 0]:
        s = x @ ok[i]
        out[i] = [int(j) for j in ids[np.lexsort((ids, -s))] if j != i][:k]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(i, rows[40][1]) for i in range(2000, 2060)]  # copies: ties
    rows += [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [None] * 16), (None, [1.0] * 16), (3080, [1.0] * 3), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in hilbert_knn.nearest(df, lambda v: v % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute_nearest([r for r in rows if r[0] != 3080], 20)  # the only vector of its dimension has no neighbour
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    unit = [(i, (np.eye(8)[i % 4] * (1 + (i % 4 == 3))).tolist()) for i in range(0, 90)]  # ties only
    ties = {}
    for r in hilbert_knn.nearest(spark.createDataFrame(unit, "vec_id long, embedding array<double>"), lambda v: v % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        ties.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert ties[20] == [(i, 1.0) for i in (0, 4, 8, 12, 16)] and ties[0] == [(i, 1.0) for i in (4, 8, 12, 16, 20)]
    assert hilbert_knn.nearest(df.limit(0), lambda v: v % 20 == 0).count() == 0
    few = hilbert_knn.nearest(df.filter("vec_id IN (0, 1, 2)"), lambda v: v % 20 == 0)
    assert sorted(r["vec_id"] for r in few.collect()) == [1, 2]


def test_windows_reach_a_falling_share(spark, monkeypatch):
    """Clustered vectors in small blocks: most are never compared, and nearly all true neighbours are found."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(200, 32))
    shares, window = [], hilbert_knn.window_for
    for n in (1500, 6000):
        x = centres[rng.integers(0, 200, n)] + 0.4 * rng.normal(size=(n, 32))
        x /= np.linalg.norm(x, axis=1)[:, None]
        rows = list(enumerate(x.tolist()))
        seen = []
        monkeypatch.setattr(hilbert_knn, "window_for", lambda *a: seen.append(window(*a)) or seen[-1])
        got = {}
        for r in hilbert_knn.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda v: v % 20 == 0, least_block=16).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        want = brute_nearest(rows, 20)
        assert sum(len(got[q] & set(want[q])) for q in want) / (20 * len(want)) >= 0.9
        shares.append(seen[-1] / n)
    assert shares[1] < shares[0] < 0.05


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline
    from scorebook.llm import packing, quality_gam, quality_rules
    from scorebook.llm.byte_bpe import ByteBPE, cut
    from scorebook.llm.common import read_table, stage
    from scorebook.llm.queries import tokenizer_file

    sf = "/root/testdata/sf0.001"
    docs = read_table(spark, sf, "documents")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    model = quality_gam.train(docs, read_table(spark, sf, "labels"))
    stages, got = dict(corpus_pipeline.STAGES), {}
    for name in list(stages)[:-1]:
        docs = stage(stages[name](spark, docs, sf), name)
        assert docs.columns == columns
        got[name] = {r["doc_id"]: r for r in docs.collect()}
        assert len(got[name]) == docs.count()
    classified, ruled, single, cleaned = got.values()
    assert set(classified) == {i for i, r in rows.items() if model.score(np.array([quality_gam.features(r["text"] or "")]))[0] >= 0.3} and len(classified) < len(rows)
    left = spark.createDataFrame([tuple(r) for r in classified.values()], read_table(spark, sf, "documents").schema)
    assert set(ruled) == {r["doc_id"] for r in quality_rules.judge(left).collect() if r["kept"]}
    assert set(single) == {c for _, c in brute_components([(i, r["text"]) for i, r in ruled.items()], 5, 80).values()} and len(single) < len(ruled)
    seen = set()
    for i in sorted(single):
        raw = single[i]["text"].encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        want = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
        assert cleaned[i]["text"] == want and cleaned[i]["n_chars"] == len(want)
    assert set(cleaned) == set(single)
    bpe, pieces, bins = ByteBPE(tokenizer_file("byte_bpe_50k.json")), set(), {}
    for i, r in cleaned.items():
        pieces |= {(i, k, s, n) for k, (s, n) in enumerate(cut(len(bpe.one(r["text"])) + 1, 2048))}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"]) for r in packed} == pieces and len(packed) == len(pieces)
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 2048
    assert len(bins) <= packing.lower_bound(np.bincount([r["length"] for r in packed], minlength=2049), 2048) + 1


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    long = " ".join(f"word{i}" for i in range(120))
    rows = [(1, long, "en", "a", 5, 1), (1, long, "en", "a", 5, 2), (None, long, None, None, 5, 3), (None, None, "en", "a", None, 4), (2, "", "en", "a", 0, 5), (2, long[:-40], "?", "", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id int")
    for name, apply in corpus_pipeline.STAGES:
        out, none = apply(spark, docs, sf), apply(spark, docs.limit(0), sf)
        assert none.count() == 0
        if name == "best_fit_packing":
            assert out.count() >= len(rows) and out.filter("doc_id IS NULL").count() >= 2
            continue
        assert out.columns == docs.columns and {r["_id"] for r in out.collect()} <= {1, 2, 3, 4, 5, 6}
        if name == "quality_rules":
            assert {r["_id"] for r in out.collect()} == {1, 2, 3, 6}  # texts without words fail, null ids or not
        if name == "jaccard_join":
            assert {r["_id"] for r in out.collect()} >= {4, 5} and out.count() == 3  # one of the copies stays
        if name == "suffix_dedup":
            by = {r["_id"]: r["text"] for r in out.collect()}
            assert len(by) == 6 and by[3] == long and by[4] is None and by[1] == by[2] == ""
