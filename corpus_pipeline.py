"""The corpus pipeline: toxicity, line dedup, near-duplicates, mixing, packing - five operators of quarrylight.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents (n_chars is counted anew where a text changes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import Scratch, partitions
from quarrylight.llm.line_dedup import dedup_lines
from quarrylight.llm.minhash import near_duplicates
from quarrylight.llm.mixing import mix_sources
from quarrylight.llm.packing import pack_documents
from quarrylight.llm.toxicity import fit, score_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document of this score or more is rejected as toxic.
TOXIC = 0.7
VOCABULARY, END = "byte_bpe_50k.json", 0


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger, trained on the labels, does not reject."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs, model, spans=False, carry=True)
    return scored.filter(F.col("score") < TOXIC).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; every document stays, a text may become empty."""
    out = dedup_lines(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_dropped") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest doc_id, of each group of near-duplicates. Rows without a doc_id stay."""
    gone = near_duplicates(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of small sources again up to the repetition limit, in the order of the mixture."""
    out = mix_sources(docs)
    out = out.repartitionByRange(partitions(spark), "position").sortWithinPartitions("position", "doc_id")
    return out.select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens, in the order of the mixture."""
    return pack_documents(docs, VOCABULARY, END)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: The first and the last stage, a trained model and a tokenizer, can't be said in SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of sf_dir's documents after all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
