"""The queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, chunks, conversations, exact, language, latent, licenses, manifest, ngram_join, pages, pii, simhash, tokenids
from ledgerlens.llm.common import new_path, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-ids")
    tokenids.write_token_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return tokenids.read_token_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = vocabulary("word_bpe_49k.json")
    made = bpe.bpe_decode(bpe.bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), words).drop("text"), words)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_spans(table(spark, sf_dir, "documents")).drop("row")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, pii.fit_spans(docs)).drop("text")
    strict = F.filter("spans", lambda s: s["strict"])
    count = lambda kind: F.size(F.filter(strict, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *map(count, pii.KINDS[:4]), F.sha2(listed(strict), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return latent.find_leaks(docs, table(spark, sf_dir, "benchmark"), latent.fit_space(docs))


def op8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit_languages(docs, language.fold(F.col("doc_id")) != 0)
    found = language.identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (language.fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "languages")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    return pages.extract_text(rows, pages.fit_pages(rows)).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.known_digests(spark))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(manifest.tampered(F.col("doc_id")), manifest.leaf_digest(n_chars=F.col("n_chars") + 1))
    made = manifest.build_manifest(table(spark, sf_dir, "documents"), {"changed": changed})
    proofs = manifest.prove(made, made.leaves.withColumn("claim", F.coalesce("changed", "leaf")).drop("changed"), "claim")
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = conversations.repair_conversations(conversations.damaged(table(spark, sf_dir, "conversations")))
    return made.conversations.join(conversations.text_digests(made.pieces), "conv").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_ids": op1_token_ids,
    "op2_bpe": op2_bpe,
    "op3_chunk_dedup": op3_chunk_dedup,
    "op4_personal_data": op4_personal_data,
    "op5_ngram_join": op5_ngram_join,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_benchmark_leaks": op7_benchmark_leaks,
    "op8_languages": op8_languages,
    "op9_main_text": op9_main_text,
    "op10_licenses": op10_licenses,
    "op11_simhash": op11_simhash,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES: dict[str, str] = {"op6_exact_dedup": exact.SQL, "op10_licenses": licenses.sql(), "op12_merkle_manifest": manifest.SQL, "op13_conversation_repair": conversations.SQL}
