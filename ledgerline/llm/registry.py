"""The thin opN_ queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, centroids, chat, decontam, langid, mixing, oracles, pii, quality, secrets, simhash, suffix, tokenids, topk
from .common import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a deployment sets its own secret key
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), key=spark.conf.get("ledgerline.pii.key", "ledgerline"))


def op2_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    named = langid.identify(docs, langid.fit(docs), keep=["doc_id"])
    return named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # cuts are at any byte: what is left of a cut character reads as the replacement character
    return left.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.apportion(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return chat.digests(chat.format_windows(said.unionByName(probe)))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenids.write_and_read(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_quality_nbsvm": op2_quality_nbsvm,
    "op5_language_id": op5_language_id,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_mixing": op7_mixing,
    "op8_simhash": op8_simhash,
    "op9_chat": op9_chat,
    "op3_top_k": op3_top_k,
    "op4_decontaminate": op4_decontaminate,
    "op10_token_ids": op10_token_ids,
    "op11_secrets": op11_secrets,
    "op12_centroids": op12_centroids,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {"op3_top_k": oracles.TOP_K, "op7_mixing": oracles.MIX, "op9_chat": oracles.CHAT, "op12_centroids": oracles.CLUSTERS}
