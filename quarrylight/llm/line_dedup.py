"""Line dedup over levelled sorted runs of line hashes.

The index is a set of runs, each a bucketed table sorted by line hash that holds, for every hash that was new in one or more
batches, in how many documents it stood and the largest of their ids. A new batch is merge-anti-joined with the runs (their
buckets are read in place, without an exchange): what is left is new and becomes a run of level 0, so that every hash stands in one
run only; what some run holds already - few hashes, as most lines stand in one document - is kept as updates to their counts. A
level that holds `fanout` runs is compacted into one run of the next level, a merge of runs that share no hash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Scratch, lower_ascii, need, partitions, without


def lines_of(text: Column) -> Column:
    """A null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(SPACES)))


def line_hash(line: Column, min_chars: int) -> Column:
    """128 bits of the line's key; null for keys that are too short to count."""
    key = line_key(line)
    return F.when(F.length(key) >= min_chars, F.md5(key.cast("binary")))


class LineRuns:
    """Levelled sorted runs of line hashes, no hash in two of them, and the updates to their counts."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 2):
        self.spark, self.fanout, self.levels, self.updates = spark, fanout, {}, []
        self.buckets = buckets or partitions(spark)
        self.name = f"line_runs_{uuid.uuid4().hex[:12]}"
        self.made: list[str] = []

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def _write(self, df: DataFrame, placed: bool = False) -> str:
        """placed: df comes from joins of bucketed tables, whose rows lie by bucket already."""
        t = f"{self.name}_{len(self.made) + 1}"
        self.made.append(t)
        df = df if placed else df.repartition(self.buckets, "key")
        df.write.bucketBy(self.buckets, "key").sortBy("key").format("parquet").saveAsTable(t)
        return t

    def _drop(self, *tables: str) -> None:
        for t in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")

    def tables(self) -> list[str]:
        return [t for level in sorted(self.levels) for t in self.levels[level]]

    def novel(self, batch: DataFrame) -> DataFrame:
        """Rows of batch (key, ...) whose key no run holds."""
        for t in self.tables():
            batch = batch.join(self.spark.table(t).select("key").hint("merge"), "key", "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """batch: key, n_docs, last_doc, one row a key, of documents that no earlier batch held."""
        staged = self._write(batch)
        run = staged
        if self.tables():
            rows = self.spark.table(staged)
            run = self._write(self.novel(rows), placed=True)
            known = rows.join(self.spark.table(run).select("key").hint("merge"), "key", "left_anti")
            self.updates.append(self._write(known, placed=True))
            self._drop(staged)
        self.levels.setdefault(0, []).append(run)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            self.levels.setdefault(level + 1, []).append(self._write(self._merged(old), placed=True))
            self.levels[level] = []
            self._drop(*old)
            level += 1
        if len(self.updates) >= self.fanout:
            old = self.updates
            self.updates = [self._write(self._merged(old), placed=True)]
            self._drop(*old)

    def _merged(self, tables: list[str]) -> DataFrame:
        """A merge join of sorted runs, bucket by bucket (a union of bucketed tables that is grouped without an exchange loses rows in Spark 4.1)."""
        df = self.spark.table(tables[0])
        for t in tables[1:]:
            df = self._both(df, self.spark.table(t), "full_outer")
        return df

    @staticmethod
    def _both(one: DataFrame, two: DataFrame, how: str) -> DataFrame:
        return one.alias("a").join(two.alias("b").hint("merge"), "key", how).select(
            "key",
            (F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))).alias("n_docs"),
            F.greatest("a.last_doc", "b.last_doc").alias("last_doc"),
        )

    def merged(self) -> DataFrame:
        """key, n_docs, last_doc of every hash: the runs' entries, with the updates of those that came again."""
        every = self._merged(self.tables())
        return self._both(every, self._merged(self.updates), "left") if self.updates else every

    def close(self) -> None:
        self._drop(*self.made)
        self.levels, self.updates, self.made = {}, [], []


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 3, fanout: int = 2) -> DataFrame:
    """Drop lines whose key stands in at least min_docs documents, but in the document of largest id that holds it.

    docs: doc_id, text and any other columns, which are carried along; a carried column named like a computed one
    (n_lines, n_dropped, kept_text) is replaced. A null or empty text is one empty line. Rows that share a doc_id are
    one document when documents are counted, and each is cleaned. A row without doc_id counts in no document and keeps
    all its lines. An empty table gives an empty result.
    """
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    hashes = F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), lambda x: line_hash(x, min_chars)), lambda h: h.isNotNull()))
    held = docs.filter("doc_id is not null").select("doc_id", F.explode(hashes).alias("key"), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))
    held = scratch.keep(held, "held", by=("batch",))
    with LineRuns(spark, fanout=fanout) as runs:
        for b in range(batches):
            runs.add(held.filter(F.col("batch") == b).groupBy("key").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc")))
        common = scratch.keep(runs.merged().filter(F.col("n_docs") >= min_docs).select("key", "last_doc"), "common")
    gone = held.join(common, "key").filter("doc_id <> last_doc").groupBy("doc_id").agg(F.collect_set("key").alias("__gone"))
    gone = scratch.keep(gone, "gone")
    scratch.drop("held", "common")
    out = without(docs, "n_lines", "n_dropped", "kept_text", "__gone").join(gone.hint("merge"), "doc_id", "left")  # one plan at every size
    lines = lines_of(F.col("text"))
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("__gone"), line_hash(x, min_chars)), F.lit(False)))
    out = out.withColumn("__kept", F.when(F.col("__gone").isNotNull(), kept))
    return out.select(
        *[out[f"`{c}`"] for c in out.columns if not c.startswith("__")],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(lines) - F.size("__kept"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("__gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join("__kept", "\n")).alias("kept_text"),
    )
