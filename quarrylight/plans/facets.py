"""The gated facet aggregate: documents that pass the label gate, by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.session import table


def gated_facets(spark: SparkSession, sf: str) -> DataFrame:
    """Left join, a gate that fails closed on a missing label, conditional and distinct counts."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf, "labels")
    is_open = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    return (
        docs.join(labels, "doc_id", "left")
        .groupBy("lang")
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.count("quality").alias("labelled"),
            F.count_if(is_open).alias("open_documents"),
            F.count_distinct(F.when(is_open, F.col("source"))).alias("open_sources"),
            F.min(F.when(is_open, F.col("n_chars"))).alias("min_chars"),
            F.max(F.when(is_open, F.col("n_chars"))).alias("max_chars"),
        )
        .orderBy(F.coalesce(F.array_position(F.array(*map(F.lit, ("en", "fr", "de", "es"))), F.col("lang")), F.lit(99)), "lang")
    )


QUERIES = {"gated_facets": gated_facets}
ORACLE = {
    "gated_facets": """
SELECT lang, count(*) AS documents, count(quality) AS labelled,
       count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS open_documents,
       count(DISTINCT CASE WHEN quality = 1 AND toxic = 0 THEN source END) AS open_sources,
       min(CASE WHEN quality = 1 AND toxic = 0 THEN n_chars END) AS min_chars,
       max(CASE WHEN quality = 1 AND toxic = 0 THEN n_chars END) AS max_chars
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang"""
}
