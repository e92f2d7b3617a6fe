"""Jobs around the streams: one owner at a time, a cadence, the next batch of work, and the records of alerts."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds between runs and from a start to the first; minutes that a lock without a sound owner counts as busy; records of alerts.
CADENCE, PENDING, RECORDS = 120, 20, 64


class Busy(RuntimeError):
    """Another owner holds the lock."""


class Lock:
    """A lock in a shared folder: one owner at a time, as sure as the store's creation of a file that must not exist (STR-14).

    The holder beats at least every `lease` seconds. A lock whose last beat is older is moved aside and taken; of several that try,
    one creates the new one. A lock without a sound owner counts as busy for PENDING minutes. Only its owner beats or releases it.
    """

    def __init__(self, spark: SparkSession, path: str, owner: str, lease: float = 600.0):
        self.owner, self.lease = f"{owner}-{uuid.uuid4().hex}", lease
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _write(self, overwrite: bool) -> None:
        out = self._fs.create(self._path, overwrite)
        out.write(bytearray(json.dumps({"owner": self.owner}).encode()))
        out.close()

    def holder(self) -> tuple[str | None, float] | None:
        """The owner (None if there is no sound record) and the seconds since its last beat; None if the lock is free."""
        from py4j.protocol import Py4JJavaError

        try:
            age = time.time() - self._fs.getFileStatus(self._path).getModificationTime() / 1000
            source = self._fs.open(self._path)
            text = bytes(source.readAllBytes()).decode()
            source.close()
        except Py4JJavaError as e:
            if "FileNotFoundException" in str(e.java_exception):
                return None
            raise
        try:
            return json.loads(text)["owner"], age
        except (ValueError, KeyError, TypeError):
            return None, age

    def acquire(self) -> None:
        from py4j.protocol import Py4JJavaError

        held = self.holder()
        if held is not None:
            owner, age = held
            if age < (self.lease if owner else PENDING * 60):
                raise Busy(owner or "an owner that is not yet recorded")
            aside = self._path.suffix(f".stale-{uuid.uuid4().hex}")
            if not self._fs.rename(self._path, aside):
                raise Busy("the lock changed while it was taken over")
        try:
            self._write(False)
        except Py4JJavaError as e:
            raise Busy("the lock was taken in between") from e
        if (self.holder() or (None,))[0] != self.owner:
            raise Busy("the lock was taken in between")

    def beat(self) -> None:
        """A new beat; Busy if the lock is no longer this owner's."""
        if (self.holder() or (None,))[0] != self.owner:
            raise Busy("the lock is another owner's")
        self._write(True)

    def release(self) -> bool:
        """Whether the lock was this owner's and is free now."""
        if (self.holder() or (None,))[0] != self.owner:
            return False
        return self._fs.delete(self._path, False)


def due(ts: Column, before: Column, started: Column, seconds: int = CADENCE) -> Column:
    """Whether a run is due at ts: so long after the run before, or after the start where there was none (STR-13)."""
    return F.unix_seconds(ts) - F.unix_seconds(F.coalesce(before, started)) >= seconds


def start_every(df: DataFrame, each, checkpoint: str, seconds: float = CADENCE):
    """A stream that runs each(batch, number) at this cadence; after a restart it goes on behind the last batch that was completed (STR-13)."""
    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()


def next_batch(recovery: DataFrame, fresh: DataFrame, cursor: str | None, limit: int) -> DataFrame:
    """document, mode, page: the batch to do next (STR-04); no rows if there is nothing to do.

    recovery: document, position, lane, mode, page. The first document of the queue with such work goes first, with its least lane
    (primary pages, then witnesses, then audits). fresh: document, priority, page. Without recovery, the documents of the least priority take
    turns: the next one by id after the cursor, else the first. A batch has the first `limit` pages of one document.
    """
    head = recovery.agg(F.min(F.struct("position", "document", "lane")).alias("h"))
    first = recovery.crossJoin(F.broadcast(head)).filter("position = h.position AND document = h.document AND lane = h.lane").select("document", "mode", "page")
    least = fresh.agg(F.min("priority").alias("least"))
    pool = fresh.crossJoin(F.broadcast(least)).filter("priority = least")
    turn = pool.agg(F.min(F.when(F.col("document") > F.lit(cursor), F.col("document"))).alias("after"), F.min("document").alias("first")).select(F.coalesce("after", "first").alias("turn"))
    idle = head.filter("h IS NULL").select(F.lit(True).alias("idle"))
    new = pool.crossJoin(F.broadcast(turn)).filter("document = turn").crossJoin(F.broadcast(idle)).select("document", F.lit("new").alias("mode"), "page")
    return first.unionAll(new).distinct().orderBy("page").limit(limit)


def keep_records(records: DataFrame, keys, order, most: int = RECORDS) -> DataFrame:
    """The records of each key that stay: of more than `most` the first closed ones go; more than `most` open ones are an error (STR-09). records: closed (null: open)."""
    closed = F.coalesce("closed", F.lit(False))
    w = Window.partitionBy(*keys)
    excess = F.count(F.lit(1)).over(w) - most
    r = records.withColumns({"__x": excess, "__c": F.sum(closed.cast("long")).over(w), "__r": F.sum(closed.cast("long")).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))})
    r = r.withColumn("__go", F.when(F.col("__x") > F.col("__c"), F.raise_error(F.lit("too many open records")).cast("boolean")).otherwise(closed & (F.col("__r") <= F.col("__x"))))
    return r.filter("NOT __go").select(*records.columns)
