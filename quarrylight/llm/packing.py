"""Order-preserving packing by dynamic programming.

The ids of a partition's documents are one stream. Windows of at most `size` ids are cut from it; a cut is free where a
document ends, costs a little where a sentence ends, and more elsewhere; a window costs what it is padded by, which is
nothing if its length is a power of two. best[j] = cut(j) + min over i of best[i] + pad(j - i): as pad is size minus length, the minimum of
best[i] + place[i] over the places within size is kept in a monotone queue; the lengths that are powers of two are looked up one by one.
No document moves, so nothing is shuffled: each partition packs what it holds.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need
from .tokens import encoder, vocabulary_path

SENTENCE, ANYWHERE = 2, 12
#: Ids that are solved at a time; the last windows of a stretch are solved again with the next one.
STRETCH, AGAIN = 1 << 18, 8


def sentence_ends(path: str) -> np.ndarray:
    """For each id of a vocabulary, whether a sentence ends with it."""
    with open(path) as f:
        vocab = json.load(f)["model"]["vocab"]
    out = np.zeros(max(vocab.values()) + 2, bool)
    for s, i in vocab.items():
        s = s.removesuffix("</w>")
        out[i] = s[-1:] in (".", "!", "?") or "Ċ" in s  # Ċ is a line feed in byte-level vocabularies
    return out


def cut_places(ends: np.ndarray, doc_ends: np.ndarray, n: int, size: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places where a cut is considered, ascending from 0 to n, and what each costs. ends, doc_ends: places after a sentence, a document."""
    price = np.full(n + 1, -1)
    price[ends] = price[doc_ends] = price[[0, n]] = SENTENCE
    soft = np.flatnonzero(price >= 0)
    whole = soft + size  # windows without padding from any of them
    price[whole[whole < n]] = ANYWHERE
    wide = np.flatnonzero(np.diff(soft) > size // 4)
    for a, b in zip(soft[wide].tolist(), soft[wide + 1].tolist()):
        price[a : b : size // 4] = ANYWHERE
    if last:
        price[max(0, n - size) :] = ANYWHERE
    price[soft] = SENTENCE
    price[doc_ends] = 0
    price[[0, n]] = 0
    at = np.flatnonzero(price >= 0)
    return at, price[at]


def solve(at: np.ndarray, cost: np.ndarray, size: int) -> list[int]:
    """The cheapest cuts, as ascending places that end with the last one."""
    n = len(at)
    number = np.full(int(at[-1]) + 1, -1, np.int32)  # of each place, -1 if no cut is considered there
    number[at] = np.arange(n)
    # for each place, the places that lie a power of two before it
    to, since = [], []
    k = 1
    while k < size:
        h = number[np.maximum(at - k, 0)]
        j = np.flatnonzero((at >= k) & (h >= 0))
        to.append(j)
        since.append(h[j])
        k *= 2
    to, since = np.concatenate(to), np.concatenate(since)
    order = np.argsort(to, kind="stable")
    since = since[order].tolist()
    upto = np.searchsorted(to[order], np.arange(n), side="right").tolist()
    place, price = at.tolist(), cost.tolist()
    best, back, key = [0] * n, [0] * n, [0] * n
    queue, head = [0], 0  # places of ascending key; what lies before head is too far away
    for j in range(1, n):
        p = place[j]
        far = p - size
        while place[queue[head]] < far:
            head += 1
        i = queue[head]
        least = key[i] - far
        for h in since[upto[j - 1] : upto[j]]:
            if best[h] < least:
                least, i = best[h], h
        best[j] = least = least + price[j]
        back[j] = i
        key[j] = least = least + p
        while len(queue) > head and key[queue[-1]] >= least:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    while j:
        out.append(place[j])
        j = back[j]
    return out[::-1]


class _Stream:
    """What is not packed yet: ids, and for each document with ids in it: doc_id, its place here (before 0 if it began earlier), its length."""

    def __init__(self, size: int, ends: np.ndarray, first: int):
        self.size, self.is_end, self.seq = size, ends, first
        self.ids, self.docs, self.n = [], [], 0

    def add(self, doc, ids: np.ndarray) -> None:
        self.docs.append((doc, self.n, len(ids)))
        self.ids.append(ids)
        self.n += len(ids)

    def pack(self, last: bool) -> list[tuple]:
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        if not len(ids):
            return []
        ends = np.flatnonzero(self.is_end[ids]) + 1
        doc_ends = np.array([s + n for _, s, n in self.docs], np.int64)
        cuts = solve(*cut_places(ends, doc_ends, len(ids), self.size, last), self.size)
        if not last:
            cuts = cuts[: max(1, len(cuts) - AGAIN)]
        out, a, d = [], 0, 0
        for b in cuts:
            begin = a
            while a < b:
                doc, s, n = self.docs[d]
                e = min(b, s + n)
                out.append((doc, a - s, e - a, zlib.crc32(ids[a:e].astype("<u4").tobytes()), n, self.seq, a - begin))
                a = e
                if e == s + n:
                    d += 1
            self.seq += 1
        self.docs = [(doc, s - a, n) for doc, s, n in self.docs[d:]]
        self.ids, self.n = [ids[a:]], len(ids) - a
        return out


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _pack(vocabulary: str, end: int, size: int):
    def f(batches):
        enc = ends = None
        stream = None
        for batch in batches:
            if enc is None:
                enc, ends = encoder(vocabulary), sentence_ends(vocabulary_path(vocabulary))
                stream = _Stream(size, ends, TaskContext.get().partitionId() << 36)
            for a, ids in enc.batches(batch.column(1)):
                for doc, x in zip(batch.column(0).slice(a, len(ids)).to_pylist(), ids):
                    stream.add(doc, np.append(x, np.uint32(end)))
                if stream.n >= STRETCH:
                    yield from _batch(stream.pack(False))
        if stream is not None:
            yield from _batch(stream.pack(True))

    return f


def _batch(rows: list[tuple]):
    for a in range(0, len(rows), 10000):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a : a + 10000])], names=list(COLUMNS))


def pack_documents(docs: DataFrame, vocabulary: str, end: int, size: int = 1024) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece, in the order of the rows of each partition.

    docs: doc_id, text; other columns are ignored. Each document is its ids and the end id; a null or empty text is the
    end id alone. Every row is packed, with a null or a repeated doc_id too. An empty table gives an empty result.
    sequence_id is unique over all partitions; a sequence never spans two.
    """
    need(docs, "doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pack(vocabulary, end, size), ", ".join(f"{c} long" for c in COLUMNS))
