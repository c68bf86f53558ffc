"""Ops 1, 6 and 8: tokens against the libraries, packing against its definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorebook.llm import matrices, packing, piece_codec
from scorebook.llm.byte_bpe import ByteBPE, cut
from scorebook.llm.queries import tokenizer_file

BPE, SPM = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
ODD = ["", " ", "a", " a", "a ", "a  b", "a\n b\n\nc ", "naïve 漢字 🎉▁x", "<|endoftext|> it's", "<s>x</s>", "word " * 3000, "　é\u0085"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return ODD + ["".join(rng.choice("ab1 ,.'s\n\t é漢▁🎉") for _ in range(rng.randint(0, 30))) for _ in range(300)]


def test_byte_bpe_equals_the_library(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BPE)
    for t, ids in zip(texts, ByteBPE(BPE).many(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_cut():
    assert cut(0, 4) == [] and cut(3, 4) == [(0, 3)] and cut(4, 4) == [(0, 4)] and cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_and_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 200)
    bins, offsets = packing.best_fit_decreasing(lengths, 64)
    fill = np.bincount(bins, weights=lengths)
    assert fill.max() <= 64
    for b in range(len(fill)):
        at = sorted((offsets[i], lengths[i]) for i in np.flatnonzero(bins == b))
        assert [a for a, _ in at] == [sum(n for _, n in at[:i]) for i in range(len(at))]
    bound = packing.lower_bound(np.bincount(lengths, minlength=65), 64)
    assert -(-lengths.sum() // 64) <= bound <= len(fill)
    rows = matrices.fill_rows(lengths.tolist(), 64)
    assert sorted(i for r in rows for i in r) == list(range(200)) and max(sum(lengths[i] for i in r) for r in rows) <= 64
    assert len(rows) == len(fill)


def test_bound_counts_large_pieces():
    counts = np.zeros(11, int)
    counts[6] = 5  # no two fit together
    assert packing.lower_bound(counts, 10) == 5


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "null id", "x"), (50, None, "x"), (3, " a", "x"), (2**60 + 1, "large id", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string")


def test_pack_documents(spark, docs):
    bpe = ByteBPE(BPE)
    got = packing.pack_documents(docs, BPE, 64, group_rows=20).collect()
    want = []
    for r in docs.collect():
        ids = next(bpe.many([r["text"] or ""])) + b"\0" * 4
        want += [(r["doc_id"], k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, 64))]
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))] and sum(n for _, n in pieces) <= 64
    lengths = np.array([r["length"] for r in got])
    assert len(by) <= packing.lower_bound(np.bincount(lengths, minlength=65), 64) + 1
    assert packing.pack_documents(docs.limit(0), BPE).count() == 0


def test_groups_of_null_ids_stay_small_and_certified_ones_closed(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(None, 0, 0, int(n), 0) for n in rng.integers(1, 60, 400)]
    df = spark.createDataFrame(rows, packing.PIECES).repartition(4)
    groups, asked = [], []
    inner, gaps = packing.stage, packing.with_gaps
    monkeypatch.setattr(packing, "stage", lambda d, name: groups.append((name, inner(d, name))) or groups[-1][1])
    monkeypatch.setattr(packing, "with_gaps", lambda *a: asked.append(a[1]) or gaps(*a))
    got = packing.pack(df, 64, group_rows=20).collect()
    assert sorted(r["length"] for r in got) == sorted(r[3] for r in rows)
    first = next(d for name, d in groups if name == "packed0")
    sizes = [r["count"] for r in first.groupBy("part").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 60
    bins = len({r["sequence_id"] for r in got})
    assert bins <= first.filter("offset = 0").count()
    # groups above their bound come first, certified ones only when these gain nothing more
    assert asked[0] is False and asked == sorted(asked)
    known = first.filter("group_bins = group_bound")
    assert known.count() and not known.filter(gaps(64, False)).count() and known.filter(gaps(64, True)).count()
    if not any(asked):
        assert {r["round"] for r in got if r["group_bins"] == r["group_bound"]} >= {0}


def test_packed_matrices(spark, docs, tmp_path):
    m = matrices.packed_matrices(docs, BPE, 64, chunk_tokens=500)
    written = matrices.write_matrices(m, f"file://{tmp_path}/m", 64)
    back, bpe = spark.read.parquet(f"file://{tmp_path}/m").collect(), ByteBPE(BPE)
    assert matrices.digests(written).count() == len(back)
    found = {}
    for r in back:
        ids, pos, cu = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["positions"], "<i4"), r["cu_seqlens"]
        assert len(ids) == len(pos) == 64 and r["n_tokens"] == cu[-1] <= 64 and not ids[cu[-1] :].any() and not pos[cu[-1] :].any()
        for d, k, s, a, b in zip(r["doc_ids"], r["pieces"], r["starts"], cu, cu[1:]):
            assert pos[a:b].tolist() == list(range(b - a))
            found.setdefault(d, []).append((k, s, ids[a:b].tolist()))
    for r in docs.collect():
        if r["doc_id"] == 3:
            continue  # two rows
        pieces = sorted(found[r["doc_id"]])
        assert [i for p in pieces for i in p[2]] == [*np.frombuffer(next(bpe.many([r["text"] or ""])), "<u4").tolist(), 0]
    assert matrices.digests(matrices.write_matrices(matrices.packed_matrices(docs.limit(0), BPE), f"file://{tmp_path}/none")).count() == 0


def test_piece_codec(spark, docs, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SPM)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in piece_codec.encode_decode(df, SPM, batch_chars=400).collect():
        ids = sp.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    got = piece_codec.encode_decode(docs, SPM)
    assert got.count() == docs.count() and got.filter("doc_id IS NULL").count() == 1 and got.filter("doc_id = 50").first()["n_tokens"] == 0
    assert piece_codec.encode_decode(docs.limit(0), SPM).count() == 0
    assert got.filter(F.col("doc_id") == 2**60 + 1).count() == 1
