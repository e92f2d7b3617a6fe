"""Token counts of documents from flat token files that have no index.

A flat file is ids of fixed width on end, each document closed by an end-of-document id. The files are read in blocks
by independent tasks; each finds the ends in its block with one vectorised comparison and reports how many ids and
ends it has and where they stand. A prefix scan over the blocks of a file (sums of ids and ends, the largest place of
an end so far) then gives every document that crosses a boundary its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, lean, need, partitions
from .files import file_size, read_file, whole_file
from .tokens import encoder

#: Bytes of a file that one task scans at a time.
BLOCK = 4 << 20


def _write(root: str, vocabulary: str, end: int, width: int):
    """One flat file a task; rows: file, ordinal, doc_id, in the order of the file."""
    kind = np.dtype(f"<u{width}")

    def f(batches):
        first = next(iter(batches), None)
        if first is None:
            return
        enc = encoder(vocabulary, plain_specials=True)
        uri = f"{root}/part-{TaskContext.get().partitionId():06d}.bin"
        listed, done = [], 0
        with whole_file(uri) as out:
            for batch in _again(first, batches):
                for a, ids in enc.batches(batch.column(1)):
                    joined = np.concatenate([x for i in ids for x in (i, [end])])
                    out.write(joined.astype(kind).tobytes())
                listed.append(batch.column(0))
        size = file_size(uri)
        for ids in listed:
            yield pa.RecordBatch.from_arrays([pa.array([uri] * len(ids), pa.string()), pa.array([size] * len(ids), pa.int64()), pa.array(np.arange(done, done + len(ids))), ids], names=["file", "bytes", "ordinal", "doc_id"])
            done += len(ids)

    return f


def _again(first, rest):
    yield first
    yield from rest


def _scan(end: int, width: int):
    """file, offset, length -> what a block holds."""
    kind = np.dtype(f"<u{width}")

    def f(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with read_file(row["file"]) as src:
                    src.seek(row["offset"])
                    ids = np.frombuffer(src.read(row["length"]), kind)
                at = np.flatnonzero(ids == end)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]]), pa.array([row["offset"] // width]), pa.array([len(ids)], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([int(at[-1]) if len(at) else None], pa.int64()), pa.array([at.tolist()], pa.list_(pa.int64()))],
                    names=["file", "first", "n_ids", "n_ends", "last_end", "ends"],
                )

    return f


def scan_flat_files(files: DataFrame, end: int, width: int, block: int = BLOCK) -> DataFrame:
    """file, ordinal, start, n_tokens (without the end) of every document in the files (file, bytes).

    An empty file has no documents; ids after the last end are no document. The file's order numbers documents from 0.
    """
    step = block // width * width
    work = files.filter("bytes > 0").withColumn("offset", F.explode(F.expr(f"sequence(0L, bytes - 1, {step}L)")))
    work = work.select("file", "offset", F.least(F.lit(step), F.col("bytes") - F.col("offset")).alias("length"))
    blocks = work.repartition(partitions(files.sparkSession), "file", "offset").mapInArrow(_scan(end, width), "file string, first long, n_ids long, n_ends long, last_end long, ends array<long>")
    before = Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    stitched = blocks.select(
        "file", "first", "ends",
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("ends_before"),
        (F.coalesce(F.max(F.col("first") + F.col("last_end")).over(before), F.lit(-1)) + 1).alias("open_since"),
    )
    each = stitched.select("file", "first", "ends", "ends_before", "open_since", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("open_since")).otherwise(F.col("first") + F.element_at("ends", F.greatest(F.col("i"), F.lit(1))) + 1)
    return each.select("file", (F.col("ends_before") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("first") + F.col("end") - start).alias("n_tokens"))


def count_tokens(docs: DataFrame, vocabulary: str, end: int, vocabulary_size: int, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens: tokenise docs (doc_id, text; other columns are ignored) into flat files and count from the files alone.

    A null or empty text has 0 tokens; strings of special tokens in a text are ordinary text, so an end always is an
    end. Each row is counted, with a null or a repeated doc_id too. An empty table gives an empty result.
    """
    need(docs, "doc_id", "text")
    scratch = Scratch(docs.sparkSession, "token-counts")
    width = 2 if max(vocabulary_size, end + 1) <= 1 << 16 else 4
    listed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_write(scratch.path("flat"), vocabulary, end, width)), "file string, bytes long, ordinal long, doc_id long")
    listed = scratch.keep(listed, "listed")
    counts = scan_flat_files(listed.select("file", "bytes").distinct(), end, width, block)
    return listed.select("file", "ordinal", "doc_id").join(counts.hint("merge"), ["file", "ordinal"], "left").select("doc_id", "n_tokens")
