"""Op 12: links and groups of two tokenizers against the libraries and plain loops."""

import hashlib
import random
from collections import Counter

import pytest

from scorebook.llm import queries, token_alignment
from scorebook.llm.byte_bpe import _byte_of_char
from scorebook.llm.queries import tokenizer_file

BPE, SPM = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
ODD = ["", " ", "a", " a", "a ", "a  b", "a\n b\n\nc ", "na\u00efve \u6f22\u5b57 \U0001f389", "\u2581x", "<|endoftext|> it's <s>x</s><0x41>", "word " * 3000, "\u3000\u00e9\u0085", "a \nb", "a\n \nb", "tab\tx\r\n", "2024 I'll 3.14 a,b"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    letters = ["a", "b", "the", "ing", "1", " ", " ", " ", ",", ".", "\n", "\t", "\u00e9", "\u6f22", "\u2581", "\U0001f389", "'s", "\u00a0", "x\u0301"]
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(250)] + [" ".join(rng.choice(["the", "nation", "states", "of", "Union", "it's"]) for _ in range(30)) for _ in range(40)]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    whole, model = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=SPM)
    whole.encode_special_tokens = True
    at = _byte_of_char()
    spell_a = lambda i: bytes(at[c] for c in whole.id_to_token(i))
    spell_b = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("\u2581", " ").encode()
    return lambda t: whole.encode(" " + t, add_special_tokens=False).ids, model.encode, spell_a, spell_b


def one(text, libraries):
    """(A ids, B ids, links as pairs of places, groups) of one text."""
    encode_a, encode_b, spell_a, spell_b = libraries
    if not text:
        return [], [], [], ""
    a, b = encode_a(text), encode_b(text)
    spans = []
    for ids, spell in ((a, spell_a), (b, spell_b)):
        at, out, data = 0, [], b""
        for i in ids:
            out.append((at, at + len(spell(i))))
            at, data = out[-1][1], data + spell(i)
        if data != (" " + text).encode():
            return [], [], [], ""
        spans.append(out)
    links = []
    for i, (s, e) in enumerate(spans[0]):
        links += [(i, j) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, low = [], 0
    for c in cuts:
        groups.append("|".join(",".join(str(i) for i, (_, e) in zip(ids, own) if low < e <= c) for ids, own in zip((a, b), spans)))
        low = c
    return a, b, links, ";".join(groups)


def expected(rows, libraries):
    found = [(d, *one(t, libraries)) for d, t in rows]
    held = Counter(p for _, a, b, links, _ in found for p in {(a[i], b[j]) for i, j in links})
    top = {}
    for (a, _), n in held.items():
        top[a] = max(n, top.get(a, 0))
    out = []
    for d, a, b, links, groups in found:
        counts = [(held[a[i], b[j]], top[a[i]]) for i, j in links]
        digest = hashlib.sha256(groups.encode()).hexdigest() if a else ""
        out.append((d, len(a), len(b), groups.count(";") + 1 if a else 0, len(links), sum(n == m for n, m in counts), sum(n for n, _ in counts), digest))
    return out


def test_ids_equal_the_libraries(texts, libraries):
    side = token_alignment.Aligner(BPE, SPM)
    a, b = side.ids(texts)
    for t, x, y in zip(texts, a, b):
        assert x.tolist() == (libraries[0](t) if t else []) and y.tolist() == libraries[1](t)


def test_query(spark, as_rows, texts, libraries, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts) if len(t) < 2000] + [(None, "null id"), (None, None), (5, "the states"), (5, "the states"), (2**60 + 1, "large id")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, chunk int").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.op12_token_alignment(spark, f"file://{tmp_path}")
    want = spark.createDataFrame(expected(rows, libraries), df.schema)
    assert as_rows(df.select(want.columns)) == as_rows(want)
    # many small blocks tell the same
    many = token_alignment.align(docs, BPE, SPM, batch_chars=200)
    assert as_rows(many) == as_rows(token_alignment.align(docs, BPE, SPM))
    assert token_alignment.align(docs.limit(0), BPE, SPM).count() == 0
    assert token_alignment.align(docs.filter("text IS NULL OR text = ''"), BPE, SPM).agg({"n_links": "sum"}).first()[0] == 0


def test_long_text_and_one_encoding(spark):
    """A text of 3000 words is one block; the blocks pass one exchange that both of its readers share."""
    docs = spark.createDataFrame([(1, ODD[10]), (2, "word")], "doc_id long, text string")
    df = token_alignment.align(docs, BPE, SPM, batch_chars=100)
    got = {r["doc_id"]: r for r in df.collect()}
    assert got[1]["n_links"] == got[1]["n_a"] + got[1]["n_b"] - got[1]["n_groups"] and got[1]["n_best"] <= got[1]["n_links"]
    assert got[2]["count_sum"] == 2 and got[2]["groups"].count("|") == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and final.count("encode(") == 1, plan
