"""Related items against their SQL on odd tables, and without a row a pair."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylight import plans
from quarrylight.operators import related

from . import oracle

NAME = "joi19_related_items"


def tables(spark, folder, lines, orders):
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, y int").select("o_orderkey", F.make_timestamp("y", F.lit(6), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("timestamp_ntz").alias("o_orderdate")).write.parquet(f"{folder}/orders.parquet")


def same(spark, folder):
    con = oracle.duckdb.connect()
    for t in ("lineitem", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = plans.queries()[NAME](spark, str(folder))
    oracle.assert_same(con, df, plans.oracle_sql()[NAME])
    return df


def lines_of(rng, orders, parts):
    """Twice bought parts, parts that nearly all have, pairs of parts that many share, orders without lines and lines without order or part."""
    out = [(o, rng.randrange(parts)) for o in orders for _ in range(rng.randrange(6))]
    out += [(o, p) for o in orders[::2] for p in (1000, 1001)] + [(o, 1000) for o in orders] + [(o, -7) for o in orders[::11]]
    return out + out[:50] + [(10**12, 3), (None, 3), (orders[0], None), (orders[1], 2**61)]


@pytest.mark.parametrize("seed,parts,years,step", [(1, 9, 3, 1), (2, 60, 40, -3), (3, 400, 1, 10**10), (4, 25, 7, 17)])
def test_same_as_sql(spark, tmp_path, monkeypatch, seed, parts, years, step):
    rng = random.Random(seed)
    orders = [i * step for i in range(150)]
    tables(spark, tmp_path, lines_of(rng, orders, parts), [(o, 1980 + rng.randrange(years)) for o in orders + [10**13]] + [(None, 1999)])
    monkeypatch.setattr(related, "PAIRS", 1 << 9)
    plan = same(spark, tmp_path)._jdf.queryExecution().toString()
    assert "Join" not in plan  # all pairs of a part's orders used to be rows


def test_blocks_of_pairs_and_buckets():
    """The steps in this process: any number of pairs at a time gives the same."""
    np = related.np
    rng = np.random.default_rng(4)
    item, member = rng.integers(0, 300, 1500), rng.integers(0, 40, 1500)
    places = np.arange(300)
    head = np.concatenate([[item, member, np.ones(1500, int)], [places, 1990 + places % 5, np.zeros(300, int)]], axis=1).astype(np.int64)
    columns, size, rest = related.baskets(head)

    def run(pairs):
        related.PAIRS, kept = pairs, related.PAIRS
        try:
            out = [np.stack(x) for x in related.found(np.stack([*columns, size]), rest, 6)]
        finally:
            related.PAIRS = kept
        return related.best(np.concatenate(out, axis=1), 6).to_pylist()

    own = {i: set(member[item == i].tolist()) for i in set(item.tolist())}
    want = []
    for i in sorted(own):
        near = sorted((-len(own[i] & own[j]), abs(i % 5 - j % 5), j) for j in own if j != i and own[i] & own[j])[:6]
        want += [{"item": i, "related": j, "shared": -s, "distance": d, "rank": n + 1} for n, (s, d, j) in enumerate(near)]
    assert run(1) == run(997) == run(1 << 21) == want


@pytest.mark.parametrize("odd", [(3, None), (3, 1991)])
def test_orders_without_a_date_or_with_two(spark, tmp_path, odd):
    rng = random.Random(7)
    orders = list(range(60))
    tables(spark, tmp_path, lines_of(rng, orders, 20), [(o, 1980 + o % 5) for o in orders] + [odd, (4, None) if odd[1] is None else (5, 1990)])
    same(spark, tmp_path)


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [])
    assert plans.queries()[NAME](spark, str(tmp_path)).count() == 0
