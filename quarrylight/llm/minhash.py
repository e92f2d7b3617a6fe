"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

Texts with equal shingle sets are one node. Each node has one signature: its shingle hashes are dealt into bins by
their leading bits and the least of each bin is kept; an empty bin borrows from a bin that a universal hash of
(bin, attempt) picks, until it meets one that is not empty. Nodes that agree on a band of the signature share a
bucket. A bucket proposes a star - its smallest node with every other one - and each proposal is confirmed on the full
sets. A bucket whose nodes then still lie in several components is open: it proposes CENTRES more stars, from nodes of
its largest component. Where it stays open, the signatures of its nodes are held against each other within a
task, and pairs across components that may be alike enough are confirmed as well. A bucket of more than HELD nodes is
split by each of the later bands if that at least halves the comparisons, so that a pair meets in the bucket of its first band, or of its
first two, and so on, and is compared there alone; else, or after DEPTH bands, it is compared as pairs of blocks, dealt over tasks.
So pairs are only made where signatures are near, no task holds more than two blocks, and no link within a bucket is lost but
for those of texts that agree on fewer bands than their bucket was split by. Links are closed by label propagation in written tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from pyspark.sql.window import Window

from .common import Scratch, lean, need, partitions
from .kernels import U, mix, overlap, text_sets

BANDS, ROWS = 48, 5
BINS = BANDS * ROWS
#: Further stars of a bucket that the first one left open.
CENTRES = 3
#: Nodes of a bucket whose signatures are compared in one task; a larger bucket is split first.
HELD = 512
#: Bins of the finer sketch by which they are compared, one byte each. A pair is dropped where its differing bins rule the similarity
#: out, or where at least FEW bins are filled and show it SIGMAS standard deviations too low.
FINE, FEW, SIGMAS = 1024, 128, 5
#: Bits of the filter that keeps texts out of the exchange if no pair asks for them; its size does not grow.
FILTER = 1 << 23
#: Bands by which a bucket is told from others at most; what is larger then is compared in pairs of blocks.
DEPTH = 3
_PLACE = np.random.default_rng(7).integers(1, 2**63, BINS, dtype=np.uint64) * U(2) + U(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS values a set (sorted, distinct, not empty)."""
    n = len(sets)
    h = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    at = row * BINS + ((h >> U(32)) * U(BINS) >> U(32)).astype(np.int64)
    first = np.empty(len(at), bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1], out=first[1:])  # sorted: the first of a bin is its least
    sig = np.zeros(n * BINS, np.uint64)
    full = np.zeros(n * BINS, bool)
    sig[at[first]] = h[first]
    full[at[first]] = True
    empty = np.flatnonzero(~full)
    attempt = 0
    while len(empty):
        attempt += 1
        base, b = empty // BINS * BINS, empty % BINS
        pick = mix(b.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(attempt * 0xC2B2AE3D27D4EB4F % 2**64))
        src = base + (pick % U(BINS)).astype(np.int64)
        good = full[src]
        sig[empty[good]] = sig[src[good]]
        empty = empty[~good]
    return sig.reshape(n, BINS)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, the band's number mixed in."""
    v = mix(sig * _PLACE).reshape(len(sig), BANDS, ROWS).sum(axis=2, dtype=np.uint64)
    return mix(v + np.arange(1, BANDS + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93)).astype(np.int64)


def fine_bins(sets: list[np.ndarray]) -> np.ndarray:
    """One row of FINE bytes a set: a hash of the least shingle hash of each bin, 0 if it has none."""
    n = len(sets)
    h = np.concatenate(sets)
    at = np.repeat(np.arange(n), [len(s) for s in sets]) * FINE + ((h >> U(32)) * U(FINE) >> U(32)).astype(np.int64)
    first = np.concatenate([[True], at[1:] != at[:-1]])
    out = np.zeros(n * FINE, np.uint8)
    out[at[first]] = (mix(h[first] ^ U(0x9FB21C651E98DF25)) % U(255)).astype(np.uint8) + 1
    return out.reshape(n, FINE)


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for a set."""
    a = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
    b = np.array([mix(s ^ U(0xA0761D6478BD642F)).sum(dtype=np.uint64) for s in sets], np.uint64)
    return mix(a + U(1)).astype(np.int64), mix(b + U(2)).astype(np.int64)


def _sketch(batches):
    """doc_id, text -> doc_id, n_shingles, the set's digest and its band keys."""
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            ids, part = batch.column(0).slice(a, 512), list(text_sets(batch.column(1).slice(a, 512)))
            d1, d2 = digests(part)
            some = [i for i, s in enumerate(part) if len(s)]
            keys, bins = np.zeros((len(part), BANDS), np.int64), np.zeros((len(part), FINE), np.uint8)
            if some:
                full = [part[i] for i in some]
                keys[some], bins[some] = band_keys(signatures(full)), fine_bins(full)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in part], pa.int64()), pa.array(d1), pa.array(d2), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([k.tobytes() for k in bins], pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "bins"],
            )


ROWS_OF_BANDS = "key long, node long, n long, path binary, parent long"


def _explode(split: bool):
    """Rows (key, node, n, path, parent) of all bands; with split, from rows with a key and a path (the bands it stands for), of that key, the parent, and each later band."""

    def f(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                node, n = part.column("node").to_numpy(), part.column("n").to_numpy()
                keys = np.frombuffer(b"".join(part.column("bands").to_pylist()), np.int64).reshape(len(node), BANDS)
                if split:
                    old, paths = part.column("key").to_numpy(), part.column("path").to_pylist()
                    last = np.array([p[-1] for p in paths])
                    keys = mix(keys.view(np.uint64) * U(3) + mix(old.view(np.uint64))[:, None]).view(np.int64)
                    i, b = np.nonzero(np.arange(BANDS)[None, :] > last[:, None])
                    path = [paths[x] + bytes([y]) for x, y in zip(i.tolist(), b.tolist())]
                else:
                    i, b = np.divmod(np.arange(keys.size), BANDS)
                    path, old = [bytes([y]) for y in range(BANDS)] * len(node), np.zeros(len(node), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys[i, b]), pa.array(node[i]), pa.array(n[i]), pa.array(path, pa.binary()), pa.array(old[i])], names=["key", "node", "n", "path", "parent"])

    return f


def _confirm(num: int, den: int):
    """a, b, a_text, b_text -> the pairs whose full sets are alike enough. Sorted by a, so that its set is made once."""

    def f(batches):
        last, kept = None, None
        for batch in batches:
            a, ta, b = batch.column(0).to_pylist(), batch.column(2), batch.column(1).to_pylist()
            out = []
            first = [i for i in range(len(a)) if i == 0 or a[i] != a[i - 1]]
            mine = dict(zip(first, text_sets(ta.take(pa.array(first, pa.int64())))))
            for i, (x, y, s) in enumerate(zip(a, b, text_sets(batch.column(3)))):
                if i in mine:
                    last, kept = x, mine[i]
                both = overlap(kept, s)
                if den * both >= num * (len(kept) + len(s) - both):
                    out.append((x, y))
            if out:
                x, y = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return f


def near_pairs(bins: np.ndarray, comp: np.ndarray, n: np.ndarray, num: int, den: int, mine=None, block: int = 512):
    """Places a < b of nodes of different components whose bins agree enough, block by block; a quarter of the bins decides first.

    mine(a, b): which of the pairs are to be compared at all.

    Where the least hashes of a bin differ, the lesser one is in one set only. So the sets differ in as many shingles as bins do, at
    least, and can share no more than half the rest: this drops no pair that is alike enough, and is near the truth where bins hold
    one shingle each. Of f bins filled in either set, the share that agrees has a variance of at most J (1 - J) / f; this is only
    asked of pairs with FEW bins filled.
    """
    rough, least = np.ascontiguousarray(bins[:, ::4]), num / den
    spread = SIGMAS * np.sqrt(max(least, 0.5) * (1 - max(least, 0.5)))

    def agree(x, y, both):
        filled = ((x | y) > 0).sum(axis=1)
        same = ((x == y) & (x > 0)).sum(axis=1)
        apart = filled - same
        can = den * (both - apart) >= num * (both + apart)
        return can & ((filled < FEW) | (same >= least * filled - spread * np.sqrt(filled)))

    for a in range(0, len(bins), block):
        for b in range(a, len(bins), block):
            apart = comp[a : a + block, None] != comp[None, b : b + block]
            lo, hi = np.minimum(n[a : a + block, None], n[None, b : b + block]), np.maximum(n[a : a + block, None], n[None, b : b + block])
            i, j = np.nonzero(apart & (lo * den >= hi * num))
            if a == b:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 13):
                u, v = i[k : k + (1 << 13)] + a, j[k : k + (1 << 13)] + b
                if mine is not None:
                    own = mine(u, v)
                    u, v = u[own], v[own]
                hit = agree(rough[u], rough[v], n[u] + n[v])
                u, v = u[hit], v[hit]
                hit = agree(bins[u], bins[v], n[u] + n[v])
                yield u[hit], v[hit]


def _near(num: int, den: int):
    """Rows in order of (key, one, two) -> pairs of a bucket's nodes that may be alike enough; of two blocks, pairs between them.

    A pair is compared only in the bucket of the first bands on which its nodes agree.
    """

    def f(batches):
        def solve(now, rows):
            _, one, two, path = now
            node, comp, n, block, bins, bands = zip(*rows)
            node, comp, n, block = np.array(node), np.array(comp), np.array(n), np.array(block)
            m = np.frombuffer(b"".join(bins), np.uint8).reshape(len(node), FINE)
            keys = np.frombuffer(b"".join(bands), np.int64).reshape(len(node), BANDS)
            keys = np.ascontiguousarray(keys[:, : path[-1] + 1])
            want = np.zeros(keys.shape[1], bool)
            want[list(path)] = True

            def mine(i, j):
                first = ((keys[i] == keys[j]) == want).all(axis=1)
                return first if one == two else first & (block[i] != block[j])

            for i, j in near_pairs(m, comp, n, num, den, mine):
                yield from _pairs(list(zip(np.minimum(node[i], node[j]).tolist(), np.maximum(node[i], node[j]).tolist())))

        now, rows = None, []
        for batch in batches:
            for key, one, two, path, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "one", "two", "path", "node", "comp", "n", "block", "bins", "bands"))):
                if (key, one, two, path) != now:
                    if rows:
                        yield from solve(now, rows)
                    now, rows = (key, one, two, path), []
                rows.append(row)
        if rows:
            yield from solve(now, rows)

    return f


def _pairs(found):
    if found:
        a, b = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _wanted(nodes: DataFrame):
    """A condition on a column of ids that holds for all of nodes and few others: a bitmap of FILTER bits over their hashes."""
    h = F.pmod(F.xxhash64("node"), F.lit(FILTER)) + 1  # from 1, as Spark puts 0 in a bucket 0 that has no place here
    got = nodes.select(h.alias("h")).groupBy(F.expr("bitmap_bucket_number(h)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("m")).collect()
    bits = np.zeros(FILTER + (1 << 15), bool)  # at most FILTER / 32768 rows of 4 kB
    for r in got:
        bits[(r["b"] - 1) << 15 : r["b"] << 15] = np.unpackbits(np.frombuffer(r["m"], np.uint8), bitorder="little")[: 1 << 15]
    packed = np.packbits(bits)

    @F.arrow_udf(BooleanType())
    def hit(x: pa.Array) -> pa.Array:
        i = x.to_numpy()
        return pa.array((packed[i >> 3] >> (7 - (i & 7)).astype(np.uint8)) & 1 == 1)

    # bucket b holds the positions (b - 1) * 32768 + 1 to b * 32768, counted by bit from 0
    pos = (F.expr("bitmap_bucket_number(pmod(xxhash64(node), %d) + 1) - 1" % FILTER) * 32768 + F.expr("bitmap_bit_position(pmod(xxhash64(node), %d) + 1)" % FILTER)).cast("long")
    return hit(pos)


def could(n1: Column, n2: Column, num: int, den: int) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return F.least(n1, n2) * den >= F.greatest(n1, n2) * num


def components(links: DataFrame, nodes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, comp: the smallest node reachable, by alternating hooks and jumps; each round is a written table.

    links: a, b; nodes: node (a superset of the links' ends is fine; those without links are left out).
    """
    edges = scratch.keep(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-edges")
    label = scratch.keep(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), f"{name}-0")
    step = 0
    while True:
        # the smallest label next door, then the label of that label
        near = edges.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        hooked = label.join(near, "node").select("node", F.least("comp", "m").alias("comp"), F.col("comp").alias("old"))
        jump = label.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        step += 1
        now = scratch.keep(hooked.join(jump, "comp", "left").select("node", F.least("comp", F.coalesce("up", "comp")).alias("comp"), "old"), f"{name}-{step}")
        changed = now.filter("comp <> old").limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        label = now.select("node", "comp")
        if not changed:
            scratch.drop(f"{name}-edges")
            return label


def near_duplicates(docs: DataFrame, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; links: den * |A and B| >= num * |A or B| over sets of 5-word shingles.

    docs: doc_id, text; other columns are ignored. Words are runs without white space, A-Z as a-z. A text of fewer than
    five words has its whole sequence as one shingle; a text without words (or null) has none and is linked with
    nothing. component_id is the smallest doc_id reachable. A row without doc_id is linked with nothing: its component_id is
    null and it is kept. Rows that share a doc_id and a text are one; of different texts under one doc_id only one is compared with others, for
    which both rows are then placed. An empty table gives an empty result.
    """
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-duplicates")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "doc_id long, n_shingles long, d1 long, d2 long, bands binary, bins binary"
    sketch = scratch.keep(base.mapInArrow(lean(_sketch), kind), "sketch")
    sets = scratch.keep(sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n")), "sets")
    nodes = sketch.withColumnRenamed("doc_id", "node").join(sets.select("d1", "d2", "node", "n"), ["d1", "d2", "node"]).select("node", "n", "bands", "bins").dropDuplicates(["node"])
    nodes = scratch.keep(nodes, "nodes")
    texts = base.withColumnRenamed("doc_id", "node")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """pairs: a, b distinct. The texts of both come to each pair; then the full sets decide."""
        pairs = scratch.keep(pairs, f"{name}-pairs")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        some = texts.filter("node IS NOT NULL").filter(_wanted(ends)).join(ends, "node", "left_semi").dropDuplicates(["node"])
        some = scratch.keep(some, f"{name}-texts")
        full = pairs.join(some.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b").join(some.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
        links = scratch.keep(full.select("a", "b", "a_text", "b_text").mapInArrow(lean(_confirm(num, den)), "a long, b long"), f"{name}-links")
        scratch.drop(f"{name}-texts")
        scratch.release()
        return links

    def pairs_of(name: str) -> DataFrame:
        return spark.read.schema("a long, b long").parquet(scratch.path(f"{name}-pairs"))

    def shared(rows: DataFrame, name: str) -> DataFrame:
        """Rows of buckets that hold several nodes."""
        many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("centre")).filter("size > 1")
        return scratch.keep(rows.join(many, "key"), name)

    def opened(buckets: DataFrame, comp: DataFrame, name: str) -> DataFrame:
        """Rows of the buckets whose nodes lie in several components, with these, the bucket's size and its largest component."""
        rows = buckets.select("key", "node", "n", "path").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        sides = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("side")).groupBy("key")
        mixed = sides.agg(F.sum("side").alias("size"), F.max(F.struct("side", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
        return scratch.keep(rows.join(mixed.select("key", "size", F.col("top.comp").alias("main")), "key"), name)

    rows = nodes.mapInArrow(lean(_explode(False)), ROWS_OF_BANDS)
    buckets = shared(rows.drop("parent"), "buckets")
    sizes = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"))

    def star(b: DataFrame) -> DataFrame:
        pairs = b.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"), "n").distinct()
        return pairs.join(sizes, "a").filter(could(F.col("n"), F.col("n_a"), num, den)).select("a", "b")

    links = confirmed(star(buckets), "star")
    comp = components(links, nodes, scratch, "star-comp")
    tried = pairs_of("star")

    def joined(more: DataFrame, name: str) -> DataFrame:
        """The components once these links are known too: they are closed over the components there are, not over all links anew."""
        if not more.limit(1).count():
            return comp
        for end in ("a", "b"):
            more = more.join(comp.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("comp", end)).drop("comp")
        more = scratch.keep(more.filter("a <> b").distinct(), f"{name}-between")
        if not more.limit(1).count():
            return comp
        up = components(more, nodes, scratch, f"{name}-comp")
        lifted = comp.join(up.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
        return scratch.keep(lifted.union(up.join(comp.select("node"), "node", "left_anti").select("node", "comp")), name + "-all")

    for depth in range(1, DEPTH + 1):
        rows = opened(buckets, comp, f"open{depth}")
        # the CENTRES nodes of least hash of a bucket's largest component
        top = rows.filter("comp = main").select("key", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("a"), F.col("n").alias("n_a")).alias("c"))
        rank = Window.partitionBy("key").orderBy("c")
        top = top.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= CENTRES).select("key", "c.a", "c.n_a")
        more = rows.filter("comp <> main").select("key", "node", "n").join(top, "key").filter(could(F.col("n"), F.col("n_a"), num, den))
        more = more.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        new = confirmed(more, f"stars{depth}")
        tried = tried.union(pairs_of(f"stars{depth}"))
        comp = joined(new, f"stars{depth}")
        rows = opened(rows, comp, f"left{depth}")
        large = rows.filter(F.col("size") > HELD)
        deeper = depth < DEPTH and large.limit(1).count() > 0
        if deeper:
            split = large.join(nodes.select("node", "bands"), "node").select("node", "n", "bands", "key", "path").mapInArrow(lean(_explode(True)), ROWS_OF_BANDS)
            split = scratch.keep(split, f"split{depth}")
            work = split.groupBy("key", "parent").agg(F.count(F.lit(1)).alias("m")).groupBy("parent").agg(F.sum(F.col("m") * F.col("m")).alias("work"))
            halved = large.select(F.col("key").alias("parent"), "size").distinct().join(work, "parent").filter(2 * F.col("work") <= F.col("size") * F.col("size"))
            halved = scratch.keep(halved.select("parent"), f"halved{depth}")
            held = rows.join(halved.select(F.col("parent").alias("key")), "key", "left_anti")
            deeper = halved.limit(1).count() > 0
        else:
            held = rows
        # a bucket of B blocks has B (B + 1) / 2 pairs of them; a row goes to those of its block
        count = F.ceil(F.col("size") / HELD).cast("int")
        held = held.withColumn("block", F.pmod(F.xxhash64("node"), count).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
        held = held.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "path", "node", "comp", "n", "block")
        held = held.join(nodes.select("node", "bins", "bands"), "node")
        held = held.repartition(partitions(spark), "key", "one", "two").sortWithinPartitions("key", "one", "two", "path")
        held = held.select("key", "one", "two", "path", "node", "comp", "n", "block", "bins", "bands")
        near = held.mapInArrow(lean(_near(num, den)), "a long, b long").distinct().join(tried, ["a", "b"], "left_anti")
        new = confirmed(near, f"near{depth}")
        tried = tried.union(pairs_of(f"near{depth}"))
        comp = joined(new, f"near{depth}")
        if not deeper:
            break
        buckets = shared(split.join(halved, "parent", "left_semi").drop("parent"), f"buckets{depth}")
        new = confirmed(star(buckets).join(tried, ["a", "b"], "left_anti"), f"star{depth}")
        tried = tried.union(pairs_of(f"star{depth}"))
        comp = joined(new, f"star{depth}")
    placed = sketch.select("doc_id", "n_shingles", "d1", "d2").join(sets.select("d1", "d2", "node"), ["d1", "d2"], "left").join(comp, "node", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "node", "doc_id"))
    return placed.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(found == F.col("doc_id"), F.lit(True)).alias("kept"))
