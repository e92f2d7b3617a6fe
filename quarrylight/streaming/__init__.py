"""Stateful behaviours: rate limits, retries, stalls, alerts, windows - as Structured Streaming and as batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.window import Window

from quarrylight.sources import read_optional

#: Minutes until the next attempt, by failures so far, and the failures that quarantine.
DELAYS, QUARANTINE = (10, 30, 120, 360), 5


def event_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1000) -> DataFrame:
    """A file stream with ts as an instant, which a watermark needs."""
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():  # a stream reads folders
        folder, _, name = path.rpartition("/")
        read, path = read.option("pathGlobFilter", name), folder
    df = read.parquet(path)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


# --- rate limits (STR-01) ------------------------------------------------------------------------


def window_counts(events: DataFrame, keys, seconds: int, watermark: str | None = None) -> DataFrame:
    """Events of a key in epoch-aligned windows; the same for a batch and for a stream."""
    if watermark and events.isStreaming:
        events = events.withWatermark("ts", watermark)
    g = events.groupBy(F.window("ts", f"{seconds} seconds"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.unix_timestamp("window.start").alias("window_start"), *keys, "n")


def rate_verdicts(events: DataFrame, keys, order, limit: int, seconds: int) -> DataFrame:
    """Each event, whether its window had room for it: the first `limit` of a key and window are accepted."""
    start = (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds) * seconds).cast("long")
    w = Window.partitionBy(*keys, start).orderBy(*order)
    return events.withColumn("accepted", F.row_number().over(w) <= limit)


def sliding_counts(events: DataFrame, keys, length: str, step: str) -> DataFrame:
    """An extra of the engine: overlapping windows."""
    return events.groupBy(F.window("ts", length, step), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, keys, gap: str) -> DataFrame:
    """An extra of the engine: sessions that a gap ends."""
    return events.groupBy(F.session_window("ts", gap), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


# --- retries (STR-02, STR-03) --------------------------------------------------------------------


def next_retry(attempts: Column, failed_at: Column) -> tuple[Column, Column]:
    """When to try again after so many failures, and whether to give up; a quarantined task has no next time."""
    delay = F.element_at(F.array(*map(F.lit, DELAYS)), F.least(attempts, F.lit(len(DELAYS))).cast("int"))
    gone = attempts >= QUARANTINE
    return F.when(~gone, failed_at + F.make_dt_interval(mins=delay)), gone


RETRY_OUT = "key string, attempts int, failed_at long, quarantined boolean"
RETRY_STATE = "last_ok long, failed array<long>, undated int"
#: The microsecond that stands for no time.
NEVER = -(2**63)


def _retry(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The record depends on no order of rows, Arrow batches or triggers: of a key are kept its last success and, of the failures after it, the last QUARANTINE."""
    last, failed, undated = state.get if state.exists else (NEVER, [], 0)
    failed = np.array(failed, dtype=np.int64)
    for pdf in batches:
        at, ok = pdf["at"].to_numpy(), pdf["ok"].to_numpy()
        last = int(at[ok == 1].max(initial=last))
        failed = np.concatenate([failed, at[(ok == 0) & (at != NEVER)]])
        failed = np.sort(failed[failed > last])[-QUARANTINE:]
        undated = min(QUARANTINE, undated + int(((ok == 0) & (at == NEVER)).sum()))
    state.update((last, failed.tolist(), undated))
    loose = undated if last == NEVER else 0  # a success of any time comes after a failure of none
    yield pd.DataFrame({"key": [key[0]], "attempts": [min(QUARANTINE, len(failed) + loose)], "failed_at": [NEVER if loose or not len(failed) else failed[-1]], "quarantined": [len(failed) + loose >= QUARANTINE]})


def retry_states(outcomes: DataFrame) -> DataFrame:
    """key, ts, ok as a stream -> the retry record of each key after each batch; a success clears it. A later batch may bring earlier outcomes."""
    o = outcomes.select("key", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(NEVER)).alias("at"), F.coalesce(F.col("ok").cast("int"), F.lit(-1)).alias("ok"))
    r = o.groupBy("key").applyInPandasWithState(_retry, RETRY_OUT, RETRY_STATE, "update", GroupStateTimeout.NoTimeout)
    at, _ = next_retry(F.col("attempts"), F.timestamp_micros(F.nullif(F.col("failed_at"), F.lit(NEVER))))
    return r.select("key", "attempts", F.when(F.col("attempts") > 0, at).alias("next_retry_at"), "quarantined")


def retry_ledger(outcomes: DataFrame) -> DataFrame:
    """The batch twin: failures since the last success of each key."""
    w = Window.partitionBy("key")
    last_ok = F.max(F.when(F.col("ok"), F.col("ts"))).over(w)
    since = outcomes.withColumn("last_ok", last_ok)
    fails = since.groupBy("key").agg(F.count_if(~F.col("ok") & (F.col("last_ok").isNull() | (F.col("ts") > F.col("last_ok")))).cast("int").alias("raw"), F.array_sort(F.collect_list(F.when(~F.col("ok") & (F.col("last_ok").isNull() | (F.col("ts") > F.col("last_ok"))), F.col("ts")))).alias("times"))
    attempts = F.least("raw", F.lit(QUARANTINE))
    at, gone = next_retry(attempts, F.try_element_at("times", attempts))
    return fails.select("key", attempts.alias("attempts"), F.when(attempts > 0, at).alias("next_retry_at"), gone.alias("quarantined"))


def pending(expected: DataFrame, completed: DataFrame, blocked: DataFrame, keys, limit: int) -> DataFrame:
    """The first tasks, in order, that are neither completed nor blocked."""
    return expected.join(completed, keys, "left_anti").join(blocked, keys, "left_anti").orderBy(*keys).limit(limit)


# --- monitors and alerts (STR-05..09) ------------------------------------------------------------

RANK = {"ok": 0, "warning": 1, "stalled": 2, "blocked": 3}


def severity(codes: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """The gravest severity of a key's codes, each code once (STR-07). codes: key, code; rules: code, severity."""
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    j = codes.select(key, "code").distinct().join(rules, "code", "left").withColumn("severity", F.coalesce("severity", F.lit("ok")))
    return j.groupBy(key).agg(F.max_by("severity", F.element_at(rank, F.col("severity"))).alias("severity"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


def health(df: DataFrame) -> DataFrame:
    """Ordered rules over a status row: the first that holds decides the action and the exit code (STR-05)."""
    a = F.when(F.col("failed") > 0, F.struct(F.lit("halt").alias("action"), F.lit(2).alias("exit_code")))
    a = a.when(F.col("pending") == 0, F.struct(F.lit("done").alias("action"), F.lit(0).alias("exit_code")))
    a = a.when(F.col("age") > 600, F.struct(F.lit("restart").alias("action"), F.lit(1).alias("exit_code")))
    a = a.otherwise(F.struct(F.lit("continue").alias("action"), F.lit(0).alias("exit_code")))
    return df.withColumn("__a", a).select(*df.columns, "__a.action", "__a.exit_code")


def alert_epochs(states: DataFrame, key: str, order) -> DataFrame:
    """key, codes, ok in order -> the alerts to send: one for each fingerprint and epoch, a recovery begins a new epoch (STR-09)."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.coalesce(F.lag("ok").over(w), F.lit(True))
    recovered = F.sum((F.col("ok") & ~before).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    e = states.withColumn("epoch", F.coalesce(recovered, F.lit(0))).filter("NOT ok")
    first = Window.partitionBy(key, "codes", "epoch").orderBy(*order)
    e = e.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    return e.withColumn("fingerprint", F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), "codes", F.col("epoch").cast("string")).cast("binary"), 256), 1, 24))


def dedupe_stream(events: DataFrame, keys, within: str) -> DataFrame:
    """The stateless-epoch part of alert dedupe, on a stream."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(list(keys))


# --- exactly once (STR-10, STR-15) ---------------------------------------------------------------


class Receipts:
    """A sink for foreachBatch: each chunk is written once, and counts once its receipt - rows and digest of what was read back - is there.

    A chunk with a receipt is not written again; one without, of a run that died half-way, is written anew. expected: the number of chunks
    that finalize() asks for.
    """

    def __init__(self, path: str, expected: int | None = None):
        self.path, self.expected = path, expected

    def _receipts(self, spark: SparkSession) -> DataFrame:
        return read_optional(spark, f"{self.path}/receipts", "chunk long, rows long, digest string")

    def done(self, spark: SparkSession) -> list[int]:
        """Numbers of the chunks that have a receipt: one number a chunk."""
        return sorted(r["chunk"] for r in self._receipts(spark).select("chunk").distinct().collect())

    @staticmethod
    def _digest(df: DataFrame):
        return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))

    def __call__(self, df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        if batch in self.done(spark):
            return
        path = f"{self.path}/chunks/chunk={batch}"
        df.write.mode("overwrite").parquet(path)
        self._digest(spark.read.schema(df.schema).parquet(path)).select(F.lit(batch).cast("long").alias("chunk"), "rows", "digest").coalesce(1).write.mode("append").parquet(f"{self.path}/receipts")

    def read(self, spark: SparkSession) -> DataFrame:
        """Rows of the chunks that have receipts; a chunk that differs from its receipt is an error."""
        got = None
        for r in self._receipts(spark).dropDuplicates(["chunk"]).orderBy("chunk").collect():
            df = spark.read.parquet(f"{self.path}/chunks/chunk={r['chunk']}")
            if tuple(self._digest(df).first()) != (r["rows"], r["digest"]):
                raise ValueError(f"chunk {r['chunk']} differs from its receipt")
            got = df if got is None else got.unionByName(df)
        if got is None:
            raise FileNotFoundError(f"no chunk in {self.path}")
        return got

    def finalize(self, spark: SparkSession) -> DataFrame:
        """read(), once all chunks from 0 to expected - 1 are there."""
        lost = sorted(set(range(self.expected or 0)) - set(self.done(spark)))
        if lost:
            raise ValueError(f"chunks without receipt: {lost[:10]}")
        return self.read(spark)


def check_bijection(asked: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """Results that are unknown, missing or there twice (STR-11); must be empty."""
    a = answered.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    j = asked.select(key).distinct().withColumn("__asked", F.lit(True)).join(a, key, "full_outer")
    problem = F.when(F.col("__asked").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate")
    return j.select(key, problem.alias("problem")).filter("problem IS NOT NULL")
