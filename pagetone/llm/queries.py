"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetone.llm import conversations, decontaminate, html_text, license_scan, minhash, mixing, phrases, quality, sharding, simhash, token_files, topk, toxicity
from pagetone.llm.common import held_out, labelled_rows, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = labelled_rows(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out(F.col("__key"), 3, 1),
                             {1: toxicity.MAX_TOXIC, 0: toxicity.MAX_CLEAN})
    scored = toxicity.classify(docs.select("doc_id", "text"), labelled)
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), width=3, radius=3)
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign_shards(docs, ["doc_id"], slot_col="slot")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.filter("vec_id % 100 = 0"), vectors, k=10)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.classify(docs.select("doc_id", "text"), quality_rows(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def quality_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return labelled_rows(docs, labels, "quality", ~held_out(F.col("__key"), 5, 0),
                         {1: quality.MAX_LABELLED // 2, 0: quality.MAX_LABELLED // 2})


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_tokens(manifest)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))[0].drop("order")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed(
        "component", "component_id")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_license_scan": op1_license_scan, "op2_toxicity": op2_toxicity, "op3_simhash": op3_simhash,
    "op4_sharding": op4_sharding, "op5_topk": op5_topk, "op6_quality": op6_quality,
    "op7_decontaminate": op7_decontaminate, "op8_token_files": op8_token_files, "op9_mixing": op9_mixing,
    "op10_html_text": op10_html_text, "op11_minhash": op11_minhash, "op12_phrases": op12_phrases,
    "op13_conversations": op13_conversations,
}
