"""Repeated passages, exactly: every byte covered by a string of 200 bytes that also starts anywhere else.

Two strings that are equal have the same least hash among their k-grams, so every string of 200 bytes is owned by that hash, and
consecutive starts with one owner are one run. Equal strings are owned by equal hashes: only runs whose hash
occurs again, in another run or in themselves, can repeat anything. Runs that are equal as a whole repeat in every string; what is left - runs that equal no other
as a whole, beside one copy of those with the same owner - is dealt into shards by owner, and the
induced sort of each shard's text finds the strings that start twice. Whether runs of one owner are equal is told by 64 bits mixed from
two unrelated fingerprints, one of them modulo a prime. A shard's text, sample, ranks and names are held in memory,
only the queues of the sort spill; an owner's runs are not split, so the runs of one owner must fit in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, lean, need, partitions
from .induced import BASE, MEMORY, repeated_starts
from .kernels import _BASE, _INV, U, _power, chunks, mix, utf8_batch

LENGTH, GRAM = 200, 32
#: Bytes of text that a shard holds on average.
SHARD = 3 << 20
#: The modulus and base of the second fingerprint of a run.
PRIME, _ROOT = (1 << 31) - 1, 1_103_515_245
_residues: dict[int, np.ndarray] = {}
_RAW = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def _residue_powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo PRIME."""
    have = _residues.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < n:
            have = np.concatenate([have, have * U(pow(base, len(have), PRIME)) % U(PRIME)])
        if n <= 1 << 22:  # not kept for one very long text
            _residues[base] = have
    return have


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Of a chunk: text, first start, number of starts, owner, a digest of the bytes of every run, and whether its owner may occur twice in it."""
    n, w = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return (none,) * 6
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_RAW[data] * _power("p", _BASE, n + 1)[:n], out=total[1:])
    inv = _power("q", _INV, n + 1)
    h = mix((total[gram:] - total[:-gram]) * inv[: n - gram + 1])
    m = len(h)
    least = _sliding(np.minimum, h, w, 2**64 - 1)
    # grams that own a string: no greater than the greatest minimum of the windows that hold them
    blank = np.zeros(w - 1, np.uint64)
    owner_at = np.flatnonzero(_sliding(np.maximum, np.concatenate([blank, least, blank]), w, 0) == h)
    twin = h[owner_at[1:]][h[owner_at[1:]] == h[owner_at[:-1]]]
    # a start counts if its string ends within the text
    size = np.diff(offsets)
    inside = np.zeros(len(least) + 1, np.int32)
    long = size >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, np.minimum(offsets[1:][long] - length + 1, len(least)), -1)
    ok = np.cumsum(inside[:-1]) > 0
    new = ok.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~ok[:-1]
    new[offsets[:-1][long]] = True
    start = np.flatnonzero(new)
    stop = np.zeros(len(least) + 1, bool)
    stop[:-1] = new | ~ok
    stop[-1] = True
    ends = np.flatnonzero(stop)
    count = ends[np.searchsorted(ends, start, side="right")] - start
    text = np.searchsorted(offsets, start, side="right") - 1
    digest = mix((total[start + count - 1 + length] - total[start]) * inv[start] + count.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    value = np.zeros(n + 1, np.uint64)
    np.cumsum((_RAW[data] >> U(33)) * _residue_powers(_ROOT, n)[:n] % U(PRIME), out=value[1:])
    second = (value[start + count - 1 + length] - value[start]) % U(PRIME) * _residue_powers(pow(_ROOT, -1, PRIME), n)[start] % U(PRIME)
    digest = mix(digest ^ (second * U(0xC2B2AE3D27D4EB4F)))
    return text, start - offsets[text], count, least[start].view(np.int64), digest.view(np.int64), np.isin(least[start], twin)


def _sliding(f, x: np.ndarray, w: int, rest: int) -> np.ndarray:
    """f over every w values on end, from running ones in blocks of w, forwards and backwards."""
    n = len(x)
    b = np.concatenate([x, np.full(-n % w, rest, np.uint64)]).reshape(-1, w)
    back = f.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[: n - w + 1], f.accumulate(b, axis=1).ravel()[w - 1 : n])


def _runs(length: int):
    def f(batches):
        for batch in batches:
            key = batch.column(0).to_numpy()
            data, off = utf8_batch(batch.column(1))
            for a, b in chunks(off):
                text, start, count, owner, digest, twice = runs(data[off[a] : off[b]], off[a : b + 1] - off[a], length)
                if len(text):
                    yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(digest), pa.array(key[a + text]), pa.array(start), pa.array(count), pa.array(twice)], names=["owner", "digest", "key", "start", "n", "twice"])

    return f


def _merge(spans: np.ndarray) -> np.ndarray:
    """Spans (start, end) as ascending disjoint ones that do not touch."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > end[:-1]])
    return np.stack([spans[new, 0], end[np.concatenate([new[1:], [True]])]], axis=1)


def _cut(length: int):
    """key, text, owner runs of a document -> the bytes of each run: shard, key, start, bytes."""

    def f(batches):
        for batch in batches:
            shard, key, start, size, text = [], [], [], [], []
            for row in batch.to_pylist():
                raw = (row["text"] or "").encode()
                for r in row["runs"]:
                    shard.append(r["shard"])
                    key.append(row["key"])
                    start.append(r["start"])
                    text.append(raw[r["start"] : r["start"] + r["n"] - 1 + length])
            for a in range(0, len(key), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(shard[a : a + 5000], pa.int64()), pa.array(key[a : a + 5000], pa.int64()), pa.array(start[a : a + 5000], pa.int64()), pa.array(text[a : a + 5000], pa.binary())], names=["shard", "key", "start", "bytes"])

    return f


def _sort_shard(length: int, base: int = BASE, memory: int = MEMORY, folder=None):
    """Rows in order (shard, key, start): the pieces of a document that touch are one segment. Yields key, start, end of what repeats."""

    def solve(segments):
        # a segment: key, start, list of bytes
        raw = [b"".join(s[2]) for s in segments]
        sizes = np.array([len(r) + 1 for r in raw])
        at = np.cumsum(sizes) - sizes
        t = np.ones(int(sizes.sum()) + 1, np.uint16)  # 1 parts the segments, 0 ends the text
        for a, r in zip(at.tolist(), raw):
            t[a : a + len(r)] = np.frombuffer(r, np.uint8).astype(np.uint16) + 2
        t[-1] = 0
        hit = repeated_starts(t, length, base, memory, folder)
        left = np.zeros(len(t), np.int64)
        left[:-1] = np.repeat(at + sizes - 1, sizes) - np.arange(len(t) - 1)
        hit &= left >= length  # not across segments
        begin = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
        end = np.flatnonzero(hit & ~np.concatenate([hit[1:], [False]]))
        which = np.searchsorted(at, begin, side="right") - 1
        key = np.array([s[0] for s in segments], np.int64)[which]
        first = np.array([s[1] for s in segments], np.int64)[which] - at[which]
        for a in range(0, len(key), 10000):
            z = slice(a, a + 10000)
            yield pa.RecordBatch.from_arrays([pa.array(key[z]), pa.array(begin[z] + first[z]), pa.array(end[z] + first[z] + length)], names=["key", "start", "stop"])

    def f(batches):
        now, segments = None, []
        for batch in batches:
            for shard, key, start, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if shard != now:
                    if segments:
                        yield from solve(segments)
                    now, segments = shard, []
                if segments and segments[-1][0] == key and start <= segments[-1][1] + segments[-1][3]:
                    s = segments[-1]
                    more = raw[s[1] + s[3] - start :]
                    s[2].append(more)
                    s[3] += len(more)
                else:
                    segments.append([key, start, [raw], len(raw)])
        if segments:
            yield from solve(segments)

    return f


def _remove(batches):
    """key, doc_id, text, spans -> doc_id, n_bytes, n_removed, n_spans, kept."""
    for batch in batches:
        cols = [[], [], [], [], []]
        for row in batch.to_pylist():
            raw = (row["text"] or "").encode()
            out, gone, n = raw, 0, 0
            if row["spans"]:
                spans = _merge(np.array([(s["start"], s["stop"]) for s in row["spans"]], np.int64))
                n, gone = len(spans), int((spans[:, 1] - spans[:, 0]).sum())
                edge = [0, *spans.ravel().tolist(), len(raw)]
                out = b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2]))
            for c, v in zip(cols, (row["doc_id"], len(raw), gone, n, out)):
                c.append(v)
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """key, doc_id, text; the key is doc_id where every row has its own, else a number given once in a written table."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    odd = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").limit(1).count()
    if not odd:
        return rows.select(F.col("doc_id").alias("key"), "doc_id", "text")
    return scratch.keep(rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "rows")


def remove_repeats(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, base: int = BASE, memory: int = MEMORY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row of docs (doc_id, text; other columns are ignored).

    shard: bytes of text sorted at a time, on average; base: names sorted directly; memory: entries of a queue held before it spills.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in this text or another, copies
    and overlaps included; matches do not cross texts and are judged on the input. A null text is empty. Texts shorter than length
    keep all. Rows with a null or a repeated doc_id are texts of their own. An empty table gives an empty result.
    """
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    rows = _keyed(docs, scratch)
    every = scratch.keep(rows.select("key", "text").mapInArrow(lean(_runs(length)), "owner long, digest long, key long, start long, n long, twice boolean"), "runs")
    again = every.groupBy("owner").agg(F.count(F.lit(1)).alias("m"), F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.bool_or("twice").alias("twice")).filter("m > 1 OR twice")
    again = again.select("owner", ((F.col("m") == 1) | (F.col("lo") != F.col("hi"))).alias("mixed"))
    shared = scratch.keep(every.drop("twice").join(again, "owner"), "shared")
    scratch.drop("runs")
    scratch.release()
    # in an owner's runs of several kinds, a kind that occurs once is open
    mixed = shared.filter("mixed")
    kinds = scratch.keep(mixed.groupBy("owner", "digest").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("key", "start", "n")).alias("one")), "kinds")
    open_owners = kinds.filter("m = 1").select("owner").distinct()
    ask = kinds.join(open_owners, "owner", "left_semi").select("owner", "one.key", "one.start", "one.n")
    total = ask.agg(F.sum(F.col("n") + length).alias("n")).first()["n"] or 0
    shards = max(1, int(total // shard))
    ask = ask.select("key", F.struct(F.pmod("owner", F.lit(shards)).alias("shard"), "start", "n").alias("r")).groupBy("key").agg(F.collect_list("r").alias("runs"))
    pieces = ask.hint("shuffle_hash").join(rows.select("key", "text"), "key").mapInArrow(lean(_cut(length)), "shard long, key long, start long, bytes binary")
    pieces = scratch.keep(pieces, "pieces")
    scratch.release()
    n = min(max(partitions(spark), shards), 100_000)
    dealt = pieces.repartition(n, "shard").sortWithinPartitions("shard", "key", "start")
    found = scratch.keep(dealt.mapInArrow(lean(_sort_shard(length, base, memory)), "key long, start long, stop long"), "found")
    scratch.drop("pieces")
    scratch.release()
    # runs that occur whole more than once
    whole = shared.filter("NOT mixed").select("key", "start", "n")
    some = mixed.join(kinds.filter("m > 1").select("owner", "digest"), ["owner", "digest"], "left_semi").select("key", "start", "n")
    whole = whole.union(some).select("key", "start", (F.col("start") + F.col("n") - 1 + length).alias("stop"))
    # spans of a text that touch are one before they travel
    w = Window.partitionBy("key").orderBy("start", "stop")
    spans = whole.union(found).withColumn("reach", F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("part", F.sum((F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("key", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    spans = scratch.keep(spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    scratch.drop("shared", "kinds", "found")
    scratch.release()
    return rows.join(spans.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "spans").mapInArrow(lean(_remove), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
