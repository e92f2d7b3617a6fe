"""Items that share members, the nearest of each: without a row for each pair (JOI-19).

Three rounds deal rows out by a key, as blocks of columns packed by a general compressor: lines by item, which gives the baskets; members by
member, each with the rest of its basket; what was found by item. Among the rows of one member it can be told of any two items how much their
baskets share, so each row yields its best `k` at most, and the best of an item are among those of its members. Of the items that share
nothing else only the nearest matter, and these are the same for all of one place; the others are met through a second member in common.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.session import ship

#: Rows that a bucket is meant to hold, rows that are dealt out at a time, pairs that are counted at a time.
BUCKET, CHUNK, PAIRS = 200_000, 1 << 19, 1 << 21
BLOCK = "bucket int, n long, m long, head binary, tail binary"
OUT = "item long, related long, shared long, distance int, rank int"


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of one length, the first as differences, by place of the byte, compressed."""
    a = np.stack(columns).astype(np.int64)
    a[0] = np.diff(a[0], prepend=0)
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(*a.shape, 8).transpose(0, 2, 1)).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, columns: int, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=columns * n * 8, codec="zstd"), np.uint8)
    a = np.ascontiguousarray(raw.reshape(columns, 8, n).transpose(0, 2, 1)).view(np.int64).reshape(columns, n)
    a[0] = np.cumsum(a[0])
    return a


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, on end."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def deal(columns: list[np.ndarray], buckets: int, size: np.ndarray | None = None, tail: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as blocks, by a hash of the first column. size: how many of tail belong to each row."""
    to = ((columns[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
    order = np.lexsort((columns[0], to))
    start = None if size is None else np.cumsum(size) - size
    cut = np.searchsorted(to[order], np.arange(buckets + 1))
    rows = []
    for b in np.flatnonzero(np.diff(cut)):
        at = order[cut[b] : cut[b + 1]]
        rest = tail[spread(start[at], size[at])] if size is not None else np.zeros(0, np.int64)
        rows.append((int(b), len(at), len(rest), pack([c[at] for c in (*columns, *([] if size is None else [size]))]), pack([rest])))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "n", "m", "head", "tail"])


def gathered(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Head and tail of each bucket, from its blocks on end; blocks come in order of buckets."""
    at, heads, tails = None, [], []
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] != at and heads:
                yield np.concatenate(heads, axis=1), np.concatenate(tails)
                heads, tails = [], []
            at = r["bucket"]
            heads.append(unpack(r["head"], columns, r["n"]))
            tails.append(unpack(r["tail"], 1, r["m"])[0])
    if heads:
        yield np.concatenate(heads, axis=1), np.concatenate(tails)


def first_of(*same: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before."""
    new = np.ones(len(same[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in same])
    return new


def ranks(new: np.ndarray) -> np.ndarray:
    """The place of each row in its run, from 0."""
    start = np.flatnonzero(new)
    return np.arange(len(new)) - np.repeat(start, np.diff(start, append=len(new)))


def baskets(head: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Lines and places of items -> member, item, place of each line, and the other members of its item."""
    item, value, line = head[:, np.lexsort((head[1], head[0], head[2]))]
    keep = first_of(item, value, line)
    item, value, line = item[keep], value[keep], line[keep]
    n = int((line == 0).sum())
    places, place_of = item[:n], value[:n]
    item, member = item[n:], value[n:]
    at = np.searchsorted(places, item)
    known = at < n
    known[known] = places[at[known]] == item[known]
    item, member, place = item[known], member[known], place_of[at[known]]
    start = np.flatnonzero(first_of(item)) if len(item) else np.zeros(0, np.int64)
    many = np.diff(start, append=len(item))
    size = np.repeat(many, many)
    rest = spread(np.repeat(start, many), size)
    rest = rest[rest != np.repeat(np.arange(len(item)), size)]
    return [member, item, place], size - 1, member[rest]


def nearest(member: np.ndarray, item: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by member, place and item -> for each row the k nearest others of its member, ties to the smaller item, as pairs of rows."""
    new = first_of(member, place)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(item))
    group = np.cumsum(first_of(member))[start]
    runs = np.arange(len(start))
    of, at = [], []
    for j in range(-k, k + 1):  # a run is needed if those before it, on its side, hold no more than k rows
        other = runs + j
        ok = (other >= 0) & (other < len(start))
        ok[ok] = group[other[ok]] == group[ok]
        r, o = runs[ok], other[ok]
        ok = (start[o] - start[r] <= k) if j > 0 else (end[r] - end[o] <= k) if j < 0 else np.ones(len(r), bool)
        r, o = r[ok], o[ok]
        size = np.minimum(end[o] - start[o], k + 1)
        of.append(np.repeat(r, size))
        at.append(spread(start[o], size))
    of, at = np.concatenate(of), np.concatenate(at)
    order = np.lexsort((item[at], np.abs(place[at] - place[start[of]]), of))
    of, at = of[order], at[order]
    rank = ranks(first_of(of))
    top = np.full((len(start), k + 1), -1, np.int64)
    top[of[rank <= k], rank[rank <= k]] = at[rank <= k]
    mine = top[np.cumsum(new) - 1]
    keep = (mine >= 0) & (mine != np.arange(len(item))[:, None])
    keep &= np.cumsum(keep, axis=1) <= k
    return np.nonzero(keep)[0], mine[keep]


def found(head: np.ndarray, tail: np.ndarray, k: int) -> Iterator[list[np.ndarray]]:
    """Rows of whole members with the rest of their baskets -> item, related, shared, distance: of each row the best k."""
    start = np.cumsum(head[3]) - head[3]
    order = np.lexsort((head[1], head[2], head[0]))
    (member, item, place, size), start = head[:, order], start[order]
    a, b = nearest(member, item, place, k)
    # rows of one member that have another one in common
    row, other = np.repeat(np.arange(len(item)), size), tail[spread(start, size)]
    group = np.cumsum(first_of(member))[row]
    order = np.lexsort((other, group))
    row = row[order]
    begin = np.flatnonzero(first_of(group[order], other[order])) if len(row) else np.zeros(0, np.int64)
    many = np.diff(begin, append=len(row))
    begin, many = np.repeat(begin, many), np.repeat(many, many)
    met = many > 1
    x, begin, many = row[met], begin[met], many[met]
    order = np.argsort(x, kind="stable")
    x, begin, many = x[order], begin[order], many[order]
    plain = ~np.isin(a, x)
    yield [item[a[plain]], item[b[plain]], np.ones(plain.sum(), np.int64), np.abs(place[a[plain]] - place[b[plain]])]
    total, i = np.cumsum(many), 0
    while i < len(x):  # whole rows, PAIRS pairs or one row at a time
        j = max(i, int(np.searchsorted(total, (total[i - 1] if i else 0) + PAIRS, "right")) - 1)
        last = x[j] if j == len(x) - 1 or x[j] == x[i] or x[j + 1] != x[j] else x[j] - 1
        j = int(np.searchsorted(x, last, "right"))
        pair = np.repeat(x[i:j], many[i:j]) * len(item) + row[spread(begin[i:j], many[i:j])]
        pair, shared = np.unique(pair, return_counts=True)
        near = slice(*np.searchsorted(a, (x[i], x[j - 1] + 1)))
        single = a[near] * len(item) + b[near]
        single = single[np.isin(a[near], x[i:j]) & ~np.isin(single, pair)]
        pair, shared = np.append(pair, single), np.append(shared + 1, np.ones(len(single), np.int64))
        p, o = pair // len(item), pair % len(item)
        p, o, shared = p[p != o], o[p != o], shared[p != o]
        distance = np.abs(place[p] - place[o])
        order = np.lexsort((item[o], distance, -shared, p))
        p, o, shared, distance = p[order], o[order], shared[order], distance[order]
        best = ranks(first_of(p)) < k
        yield [item[p[best]], item[o[best]], shared[best], distance[best]]
        i = j


def best(head: np.ndarray, k: int) -> pa.RecordBatch:
    item, related, shared, distance = head[:, np.lexsort((head[1], head[3], -head[2], head[0]))]
    new = first_of(item, related)  # the same pair, found by several members
    item, related, shared, distance = item[new], related[new], shared[new], distance[new]
    rank = ranks(first_of(item))
    keep = rank < k
    return pa.RecordBatch.from_arrays([pa.array(c[keep], t) for c, t in ((item, pa.int64()), (related, pa.int64()), (shared, pa.int64()), (distance, pa.int32()), (rank + 1, pa.int32()))], names=["item", "related", "shared", "distance", "rank"])


def related_items(lines: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """lines: item, member, whole numbers; places: item, place, one whole number an item -> the k items (item, related, shared, distance, rank) that share most members with each, then are nearest in place, then smallest."""
    s = lines.sparkSession
    ship(s)
    rows = lines.select("item", F.col("member").alias("value"), F.lit(1).alias("line")).unionAll(places.select("item", F.col("place").alias("value"), F.lit(0).alias("line")))
    rows = rows.dropna().select(*[F.col(c).cast("long").alias(c) for c in rows.columns])
    buckets = max(int(s.conf.get("spark.sql.shuffle.partitions")), lines.count() // BUCKET)

    def by_item(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            n += batch.num_rows
            if n >= CHUNK:
                yield from deal(list(np.concatenate(held, axis=1)), buckets)
                held, n = [], 0
        if n:
            yield from deal(list(np.concatenate(held, axis=1)), buckets)

    def by_member(batches):
        for head, _ in gathered(batches, 3):
            columns, size, rest = baskets(head)
            yield from deal(columns, buckets, size, rest)

    def by_item_again(batches):
        for head, tail in gathered(batches, 4):
            for columns in found(head, tail, k):
                yield from deal(columns, buckets)

    def ranked(batches):
        for head, _ in gathered(batches, 4):
            yield best(head, k)

    def exchanged(df: DataFrame, f: Callable) -> DataFrame:
        return df.mapInArrow(f, BLOCK).repartition(buckets, "bucket").sortWithinPartitions("bucket")

    return exchanged(exchanged(exchanged(rows, by_item), by_member), by_item_again).mapInArrow(ranked, OUT)
