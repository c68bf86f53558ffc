"""Op 11: runs of repeated words against their definition."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from scorebook.llm import periodic_runs, queries


def by_definition(w, least=24):
    """{(start, end): smallest period} of all runs, period by period."""
    found = {}
    for p in range(1, len(w) // 3 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i >= 2 * p and j - i + p >= least:
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e, p) for (s, e), p in found.items())


def periodic(rng):
    """Few letters, pieces repeated one to six times, and cycles of cycles."""
    n = rng.randint(0, 150)
    if rng.random() < 0.3:
        return [rng.randint(0, rng.choice([0, 1, 2, 5])) for _ in range(n)]
    out = []
    while len(out) < n:
        piece = [rng.randint(0, rng.choice([0, 1, 3])) for _ in range(rng.randint(1, 40))]
        if rng.random() < 0.5:
            piece = [rng.randint(0, 1)] * rng.randint(1, 30) + piece[: rng.randint(0, 3)]
        out += piece * rng.randint(1, 6)
    return out


@pytest.mark.parametrize("segment", [7, 60, 1 << 17])
def test_runs_of_random_words(segment):
    rng = random.Random(segment)
    for _ in range(25):
        lists = [np.array(periodic(rng), np.int64) for _ in range(rng.randint(1, 9))]
        for x, got in zip(lists, periodic_runs.runs_of(lists, segment=segment)):
            assert [tuple(r) for r in got.tolist()] == by_definition(x.tolist())


def test_long_streams_end_and_equal_hashes_decide_nothing(monkeypatch):
    assert periodic_runs.runs_of([np.zeros(60_000, np.int64)], segment=5000)[0].tolist() == [[0, 60_000, 1]]
    nested = np.array(([0] * 63 + [1]) * 300)
    got = periodic_runs.runs_of([nested], segment=1000)[0].tolist()
    assert [0, len(nested), 64] in got and len(got) == 301
    monkeypatch.setattr(periodic_runs, "_hash", lambda x: x * np.uint64(0))  # every block meets every other
    x = np.array(([1, 2, 3, 4, 5] * 7 + [9]) * 4)
    assert [tuple(r) for r in periodic_runs.runs_of([x])[0].tolist()] == by_definition(x.tolist())


def test_no_lists_and_empty_lists():
    assert periodic_runs.runs_of([]) == []
    assert [len(r) for r in periodic_runs.runs_of([np.empty(0, np.int64), np.zeros(23, np.int64), np.zeros(24, np.int64)])] == [0, 0, 1]


def expected(doc_id, text):
    w = [x for x in (text or "").encode().split()]
    if doc_id is not None:
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = by_definition(w)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    s, e, q = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    best = (None,) * 4 if s is None else (s, e - s, q, 1000 * (e - s) // q)
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode()
    return (doc_id, len(runs), *best, sha(lines), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query(spark, as_rows, tmp_path):
    rng = random.Random(3)
    texts = ["", None, "a " * 24, "a b\u00a0c\t" * 30 + "\n", "x y z " * 7 + "x y", " ".join(map(str, range(200)))]
    texts += [" ".join(f"w{x}" for x in periodic(rng)) for _ in range(120)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "a b " * 20, 2), (None, None, 2), (5, texts[2], 3), (5, texts[2], 3)]
    # documents whose tail goes round, and ties between runs of one exponent
    rows += [(i, " ".join(f"{i}v{k}" for k in range(i % 97 + 60)), 4) for i in range(1000, 1100)]
    rows += [(2000, "a " * 24 + "- " + "b " * 24 + "c d " * 24, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = as_rows(queries.op11_periodic_runs(spark, f"file://{tmp_path}"))
    key = lambda r: tuple((x is not None, str(type(x)), x) for x in r)
    assert got == sorted((expected(i, t) for i, t, _ in rows), key=key)
    assert sum(r[1] > 0 for r in got) > 60
    small = periodic_runs.find_runs(docs, rewrite=queries.cyclic_tail, batch_chars=300)
    assert as_rows(small.drop("runs")) == as_rows(periodic_runs.find_runs(docs, rewrite=queries.cyclic_tail).drop("runs"))
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
