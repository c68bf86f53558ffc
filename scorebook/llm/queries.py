"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hilbert_knn, jaccard_join, main_text, matrices, oracles, packing, periodic_runs, piece_codec, quality_gam, quality_rules, secret_scan, substring_dedup, suffix_dedup, token_alignment
from .common import read_table, shared_dir


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(read_table(spark, sf_dir, "pages"))


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_gam.score(docs, quality_gam.train(docs, read_table(spark, sf_dir, "labels")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_words(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = matrices.packed_matrices(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return matrices.digests(matrices.write_matrices(packed, f"{shared_dir(spark)}/matrices-{uuid.uuid4().hex}"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup_bytes(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_decode(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read_table(spark, sf_dir, "documents"))


def op10_hilbert_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_knn.nearest(read_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def cyclic_tail(doc_id: int, words: list[bytes]) -> list[bytes]:
    """The words that op11's query looks at: of a tenth of the documents the words from one on go round in a cycle."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a = (h // 10) % n
    p = 1 + (n - a) // (3 + (h // 10) % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(read_table(spark, sf_dir, "documents"), rewrite=cyclic_tail)
    best = found.withColumn("best", periodic_runs.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    return found.select("*", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit("")).alias("groups_sha256")).drop("groups")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read_table(spark, sf_dir, "documents"))

    def of_kind(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(listed(of_kind(*secret_scan.BASE)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_main_text": op2_main_text,
    "op3_quality_gam": op3_quality_gam,
    "op4_quality_rules": op4_quality_rules,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_packed_matrices": op6_packed_matrices,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_piece_codec": op8_piece_codec,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_hilbert_knn": op10_hilbert_knn,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_alignment": op12_token_alignment,
    "op13_secret_scan": op13_secret_scan,
}

ORACLE_SQL: dict[str, str] = oracles.SQL
