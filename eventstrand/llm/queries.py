"""Registered queries of the operators over the given tables, each with its production parameters."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventstrand.llm import alignment, counts, minhash, mixing, neighbours, packing, phrases, quality, secrets, simhash, substrings, token_files, toxicity
from eventstrand.llm.common import table
from eventstrand.llm.tokens import BYTE_BPE, PIECE_BPE, WORD_BPE, vocabulary_path

CONTEXT = 2048


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), report=report)
    base = [r.reject({c: F.col(c) for c in report}) for r in quality.RULES if r.name in quality.BASE_RULES]
    return judged.select("doc_id", *report, reduce(or_, base).alias("base_failed"), "kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_on_labels(documents, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return toxicity.score(documents, model).select("doc_id", held_out, "score", "predicted")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", *[count(kind) for kind, *_ in secrets.BASE_KINDS],
        secrets.digest(F.col("base_spans")).alias("base_sha256"), secrets.written(F.col("secret_spans")).alias("spans"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.roundtrip(documents, vocabulary_path(BYTE_BPE), end_id=2, length=CONTEXT)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(documents, vocabulary_path(BYTE_BPE), end_id=0, capacity=CONTEXT)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = counts.count_tokens(documents, vocabulary_path(WORD_BPE), limit=CONTEXT)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(embeddings, F.col("vec_id") % 50 == 0, neighbours=5)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    sized = documents.select("doc_id", "source", mixing.sizes_of(F.col("text")).alias("size"))
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(documents, vocabulary_path(BYTE_BPE), vocabulary_path(PIECE_BPE))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"), least=100, longest=5, limit=2000)


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "fingerprint", "component_id")


QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_toxicity, op3_minhash_near_dedup, op4_secret_scan, op5_token_files, op6_substring_dedup, op7_best_fit_packing, op8_token_counts, op9_graph_neighbours, op10_source_mixing, op11_tokenizer_alignment, op12_phrase_collocations, op13_simhash_near_dedup)
}
