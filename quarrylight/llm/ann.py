"""Nearest neighbours by inner product: a block matrix join over int8 tiles.

Vectors are packed into blocks. Every block of queries meets every block of candidates once, as one row of an equi-join
on a tile number. In a tile the int8 codes are multiplied (as floats, in which sums of int8 products of up to
1040 dimensions are exact); x.y differs from the scaled product by at most |ex||y'| + |x||ey|, with ex, ey the
quantisation errors and y' the decoded vector. A pair survives if its upper bound reaches the k-th largest lower bound
known for the query; survivors are recomputed in double precision and merged into a heap per query of the block at hand. So the result is
exact: no pair that belongs to the nearest k can be cut by its bound.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, lean, need, partitions

BLOCK_SCHEMA = "side string, dim int, block long, ids binary, vectors binary, codes binary, scales binary, errors binary"
#: Longer vectors are multiplied in slices of so many dimensions, so that float sums of int8 products stay exact.
SLICE = 1024
#: Candidate blocks of a tile, on average.
TILE = 16


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, a scale per row, and the norm of what the codes lose. x: float64, rows not zero."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale = np.maximum(scale, np.finfo(np.float64).tiny)
    codes = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    return codes, scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed in double precision from the first component to the last."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


def _pack(side: str, rows: int):
    def f(batches):
        held: dict[int, list] = {}
        made: dict[int, int] = {}

        def block(dim):
            ids, vecs = zip(*held.pop(dim))
            x = np.array(vecs, dtype=np.float64)
            codes, scale, err = quantise(x)
            b, made[dim] = made.get(dim, 0), made.get(dim, 0) + 1
            return {"side": side, "dim": dim, "block": b, "ids": np.array(ids, np.int64).tobytes(), "vectors": x.tobytes(), "codes": codes.tobytes(), "scales": scale.tobytes(), "errors": err.tobytes()}

        for pdf in batches:
            for i, v in zip(pdf["id"], pdf["v"]):
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= rows:
                    yield pd.DataFrame([block(len(v))])
        for dim in list(held):
            yield pd.DataFrame([block(dim)])

    return f


def _tile_bounds(qc, qs, qe, qn, cc, cs, ce, cn):
    """Lower and upper bounds of all products of a tile."""
    prod = np.zeros((len(qc), len(cc)))
    for a in range(0, qc.shape[1], SLICE):
        prod += qc[:, a : a + SLICE].astype(np.float32) @ cc[:, a : a + SLICE].astype(np.float32).T
    prod *= qs[:, None]
    prod *= cs[None, :]
    decoded = np.sqrt((cc.astype(np.float64) ** 2).sum(axis=1)) * cs
    slack = (qe[:, None] * decoded[None, :] + qn[:, None] * ce[None, :]) * (1 + 1e-9) + 1e-12 * qn[:, None] * cn[None, :]
    return prod - slack, prod + slack


def _search(k: int):
    names = ("ids", "vectors", "codes", "scales", "errors")

    def load(row, side):
        n = {c: row[f"{side}_{c}"] for c in names}
        ids = np.frombuffer(n["ids"], np.int64)
        x = np.frombuffer(n["vectors"], np.float64).reshape(len(ids), -1)
        return ids, x, np.frombuffer(n["codes"], np.int8).reshape(x.shape), np.frombuffer(n["scales"]), np.frombuffer(n["errors"]), np.sqrt((x**2).sum(axis=1))

    def flush(q, heaps):
        part = [(row, int(q["ids"][row]), -v, x) for row, h in heaps.items() for x, v in h]
        if part:
            row, query, vec, score = zip(*part)
            n = len(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([q["at"][0]] * n, pa.int32()), pa.array([q["at"][1]] * n, pa.int32()), pa.array([q["at"][2]] * n, pa.int64()), pa.array(row, pa.int32()), pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())],
                names=["q_part", "dim", "q_block", "q_row", "query_id", "vec_id", "score"],
            )

    def f(batches):
        now, heaps = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                at = (row["q_part"], row["dim"], row["q_block"], row["tile"])
                if now is None or now["at"] != at:
                    if now is not None:
                        yield from flush(now, heaps)
                    q = load(row, "q")
                    now, heaps = {"at": at, "ids": q[0]}, {}
                c = load(row, "c")
                low, high = _tile_bounds(q[2], q[3], q[4], q[5], c[2], c[3], c[4], c[5])
                own = q[0][:, None] == c[0][None, :]
                low[own] = -np.inf
                high[own] = -np.inf
                m = low.shape[1]
                kth = np.partition(low, m - k, axis=1)[:, m - k] if m >= k else np.full(len(low), -np.inf)
                for j, h in heaps.items():
                    if len(h) == k:
                        kth[j] = max(kth[j], h[0][0])
                at_q, at_c = np.nonzero((high >= kth[:, None]) & ~own)
                score = exact_products(q[1][at_q], c[1][at_c])
                for j, s, v in zip(at_q.tolist(), score.tolist(), c[0][at_c].tolist()):
                    h = heaps.setdefault(j, [])
                    if len(h) < k:
                        heapq.heappush(h, (s, -v))
                    elif (s, -v) > h[0]:
                        heapq.heapreplace(h, (s, -v))
        if now is not None:
            yield from flush(now, heaps)

    return f


def usable(vectors: DataFrame) -> DataFrame:
    """id, v: rows with an id and a vector that is neither null, empty, zero nor holds null or non-finite components."""
    v = F.col("v")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(good)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k candidates of largest inner product for every query: query_id, rank, vec_id, score; ties to the smaller vec_id.

    Rows with a null id or vector, a zero or empty vector, or null or non-finite components take no part. A candidate with the query's own
    id is left out. Vectors only meet vectors of the same length. Equal rows among the queries are one query; queries that share an
    id but not the vector are answered each on its own. Repeated candidates each take a place. Other columns are ignored. Empty tables give
    an empty result.
    """
    need(vectors, id_col, vector_col)
    need(queries, id_col, vector_col)
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    parts = partitions(spark)

    def blocks(df: DataFrame, side: str) -> DataFrame:
        df = usable(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")))
        df = df.distinct() if side == "q" else df
        b = df.mapInPandas(lean(_pack(side, block_rows)), BLOCK_SCHEMA).withColumn("part", F.spark_partition_id())
        return scratch.keep(b.drop("side"), side).select("dim", *[F.col(c).alias(f"{side}_{c}") for c in ("part", "block", "ids", "vectors", "codes", "scales", "errors")])

    # a join builds a table of one tile of candidate blocks and streams the query blocks; those of the tile meet a query block one after
    # the other, so a task holds the heaps of one query block
    q, c = blocks(queries, "q"), blocks(vectors, "c")
    tiles = max(parts, -(-c.count() // TILE))
    c = c.withColumn("tile", F.pmod(F.xxhash64("c_part", "c_block"), F.lit(tiles)).cast("int"))
    q = q.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    found = q.join(c.hint("shuffle_hash"), ["tile", "dim"]).mapInArrow(lean(_search(k)), "q_part int, dim int, q_block long, q_row int, query_id long, vec_id long, score double")
    w = Window.partitionBy("q_part", "dim", "q_block", "q_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
