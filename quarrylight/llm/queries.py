"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .fingerprint import compare_with_edited
from .line_dedup import dedup_lines
from .minhash import near_duplicates
from .mixing import mix_sources
from .packing import pack_documents
from .pfor import round_trip
from .suffix_dedup import remove_repeats
from .token_counts import count_tokens
from .toxicity import fit, held_out, score_documents


def _docs(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select(*(cols or ("doc_id", "text")))


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = dedup_lines(_docs(spark, sf))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    out = mix_sources(_docs(spark, sf, "doc_id", "text", "source"))
    return out.select("doc_id", "source", "n_tokens", "epoch", "tokens_before", F.round("epochs", 6).alias("epochs"), F.round("weight", 9).alias("weight"), F.round("position", 9).alias("position"))


def op10_nearest(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op9_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(_docs(spark, sf))


def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return count_tokens(_docs(spark, sf), "byte_bpe_50k.json", end=50256, vocabulary_size=50257)


def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(_docs(spark, sf), "byte_bpe_50k.json", end=0)


def op8_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return round_trip(_docs(spark, sf), "word_bpe_49k.json", end=1)


def op3_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return compare_with_edited(_docs(spark, sf))


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    model = fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    out = score_documents(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op2_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = remove_repeats(_docs(spark, sf))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
