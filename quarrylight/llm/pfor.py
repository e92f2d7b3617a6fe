"""Token ids in patched frame-of-reference blocks.

A file holds blocks of ids, a table of documents, an index of block starts and a footer. In a block the least id is
taken off, every rest is packed at the width that a given share of them fits, and what does not fit leaves its upper bits in a list
of exceptions (place, upper bits). Any block can be read by itself through the index.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, need, partitions
from .files import read_file, whole_file
from .tokens import encoder

MAGIC = b"QLPF0001"
_HEAD = struct.Struct("<IIBI")
_FOOT = struct.Struct("<QQQQQ8s")


def pack(v: np.ndarray, width: int) -> bytes:
    bits = np.unpackbits(v.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    bits = np.zeros((n, 32), np.uint8)
    if width:
        bits[:, :width] = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * width).reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def encode_block(ids: np.ndarray, fit: float) -> bytes:
    least = int(ids.min())
    rest = ids.astype(np.uint32) - np.uint32(least)
    at = min(len(rest) - 1, int(np.ceil(fit * len(rest))) - 1)
    width = int(np.partition(rest, at)[at]).bit_length()
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    upper = rest[odd] >> np.uint32(width) if width < 32 else rest[odd]
    low = rest & np.uint32((1 << width) - 1)
    return _HEAD.pack(len(ids), least, width, len(odd)) + pack(low, width) + odd.astype("<u2").tobytes() + upper.astype("<u4").tobytes()


def decode_block(data: bytes) -> np.ndarray:
    n, least, width, k = _HEAD.unpack_from(data)
    a = _HEAD.size
    b = a + (n * width + 7) // 8
    v = unpack(data[a:b], n, width)
    if k:
        odd = np.frombuffer(data, "<u2", k, b)
        v[odd] |= np.frombuffer(data, "<u4", k, b + 2 * k) << np.uint32(width)
    return v + np.uint32(least)


class Writer:
    def __init__(self, out, block: int = 16384, fit: float = 0.95):
        if not 0 < block <= 1 << 16 or not 0 < fit <= 1:
            raise ValueError("block: 1 to 65536 ids; fit: a share above 0")
        self.out, self.block, self.fit = out, block, fit
        self.starts, self.size, self.docs, self.ids = [], 0, [], []
        self.waiting, self.n_ids = 0, 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.ids.append(ids)
        self.waiting += len(ids)
        self.n_ids += len(ids)
        if self.waiting >= 16 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        v = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        end = len(v) if last else len(v) // self.block * self.block
        for a in range(0, end, self.block):
            self.starts.append(self.size)
            self._put(encode_block(v[a : min(a + self.block, end)], self.fit))
        self.ids, self.waiting = [v[end:]], len(v) - end

    def close(self) -> None:
        self._flush(True)
        table = self.size
        self._put(np.array([d is None for d, _ in self.docs], np.uint8).tobytes())
        self._put(np.array([d or 0 for d, _ in self.docs], "<i8").tobytes())
        self._put(np.array([n for _, n in self.docs], "<i8").tobytes())
        index = self.size
        self._put(np.array(self.starts, "<u8").tobytes())
        self._put(_FOOT.pack(table, index, len(self.docs), len(self.starts), self.n_ids, MAGIC))


class Reader:
    def __init__(self, src):
        self.src = src
        size = src.size()
        table, index, docs, blocks, self.n_ids, magic = _FOOT.unpack(self._at(size - _FOOT.size, _FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a file of packed ids, or cut short")
        self.starts = np.append(np.frombuffer(self._at(index, 8 * blocks), "<u8"), table).astype(np.int64)
        raw = self._at(table, 17 * docs)
        null, ids = np.frombuffer(raw, np.uint8, docs), np.frombuffer(raw, "<i8", docs, docs)
        self.lengths = np.frombuffer(raw, "<i8", docs, 9 * docs)
        self.doc_ids = [None if z else i for z, i in zip(null.tolist(), ids.tolist())]

    def _at(self, a: int, n: int) -> bytes:
        self.src.seek(a)
        return self.src.read(n)

    def block(self, i: int) -> np.ndarray:
        return decode_block(self._at(int(self.starts[i]), int(self.starts[i + 1] - self.starts[i])))

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """doc_id and the ids in parts, block by block."""
        have, i = np.zeros(0, np.uint32), 0
        for doc, n in zip(self.doc_ids, self.lengths.tolist()):
            parts = []
            while n > 0:
                if not len(have):
                    have, i = self.block(i), i + 1
                parts.append(have[:n])
                n -= len(parts[-1])
                have = have[len(parts[-1]) :]
            yield doc, parts


def _write(root: str, vocabulary: str, end: int, block: int, fit: float):
    def f(batches):
        enc = encoder(vocabulary)
        shard = TaskContext.get().partitionId()
        uri = f"{root}/ids-{shard:06d}.pfor"
        with whole_file(uri) as out:
            w = Writer(out, block, fit)
            for batch in batches:
                for a, ids in enc.batches(batch.column(1)):
                    for doc, x in zip(batch.column(0).slice(a, len(ids)).to_pylist(), ids):
                        w.add(doc, np.append(x, np.uint32(end)))
            w.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": pa.array([uri]), "n_docs": pa.array([len(w.docs)], pa.int64()), "n_ids": pa.array([w.n_ids], pa.int64()), "bytes": pa.array([w.size], pa.int64())})

    return f


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            with read_file(row["file"]) as src:
                out, start = [], row["base"]
                for doc, parts in Reader(src).documents():
                    crc, n = 0, 0
                    for p in parts:
                        crc, n = zlib.crc32(p.astype("<u4").tobytes(), crc), n + len(p)
                    out.append((doc, start, n, crc))
                    start += n
            for a in range(0, len(out), 10000):
                cols = list(zip(*out[a : a + 10000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_ids(docs: DataFrame, root: str, vocabulary: str, end: int, block: int = 16384, fit: float = 0.95) -> DataFrame:
    """shard, file, n_docs, n_ids, bytes: files of ids in ascending doc_id order, shard after shard.

    docs: doc_id, text; other columns are ignored. A null or empty text is the end id alone. Rows without a doc_id come
    first; rows that share one follow each other by the hash of their texts. An empty table gives files without documents.
    """
    need(docs, "doc_id", "text")
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return rows.mapInArrow(_write(root, vocabulary, end, block, fit), "shard int, file string, n_docs long, n_ids long, bytes long")


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from files (file, base) alone; a task reads the files of a partition."""
    return files.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end: int) -> DataFrame:
    """Write the ids of docs and read every document back; start counts the ids of all documents before it."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ids")
    files = scratch.keep(write_ids(docs, scratch.path("files"), vocabulary, end), "written")
    base, rows = 0, []
    for r in sorted(files.select("shard", "file", "n_ids").collect()):  # one row a file
        rows.append((r["file"], base))
        base += r["n_ids"]
    return read_ids(spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows))))
