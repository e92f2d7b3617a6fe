"""Scalar functions on hand-made rows."""

import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrylight import functions as X
from quarrylight import operators as O
from quarrylight import streaming as R
from quarrylight.operators import search as S
from quarrylight.plans.flows import latest_of_stream
from quarrylight.release import keep_generated_at, publish, read_release


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text,surface,starts", [("aaaa", "aa", [0, 2]), ("a.b.c", ".", [1, 3]), ("", "x", []), ("abc", "", [])])
def test_occurrences(spark, text, surface, starts):
    assert one(spark, X.occurrence_starts(F.col("t"), surface), t=text) == starts
    assert one(spark, X.exact_count(F.col("t"), surface), t=text) == len(starts)


def test_fnv1a(spark):
    def plain(s):
        h = 2166136261
        for b in s.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h

    for s in ("", "a", "foobar", "é漢"):
        assert one(spark, X.fnv1a(F.col("t")), t=s) == plain(s)


def test_dice(spark):
    assert one(spark, X.dice(F.lit("aaaa"), F.lit("aaa"))) == round(2 * 1 / 3, 4)
    assert one(spark, X.dice(F.lit("ab"), F.lit("ab"))) == 1.0
    assert one(spark, X.dice(F.lit("night"), F.lit("nacht"))) == 0.0


def test_rates_and_percentiles(spark):
    assert one(spark, O.rate(F.lit(1), F.lit(0))) is None
    assert one(spark, O.rate(F.lit(1), F.lit(0), empty=0.0)) == 0.0
    assert spark.range(1, 101).agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY id)")).first()[0] == 95


def test_strip_html(spark):
    html = "<style>x</style><p>a &amp; b</p><script>1</script>\n\n\n<p>c</p>"
    assert one(spark, X.strip_html(F.col("t")), t=html) == "a & b\n\nc"


def test_interpolate(spark):
    got = [one(spark, X.interpolate(F.lit(float(x)), [(0, 0.0), (10, 1.0), (50, 3.0)])) for x in (-1, 0, 5, 10, 30, 99)]
    assert got == [0.0, 0.0, 0.5, 1.0, 2.0, 3.0]


def test_planner():
    assert S.phrases("ab cde fghi") == ["ab", "cde", "fghi"]
    assert S.phrases("abcdefg") == ["abcd", "bcde", "cdef", "defg"]
    assert S.fts_query("ab cd") == '"ab" OR "cd"'
    assert S.phrases("a b") == []


@pytest.mark.parametrize("answer,allowed,valid", [("Fact one. Fact two.[P:12]", {12}, False), ("The value is 3.2.[P:12]", {12}, True), ("So it is.[P:12,13]", {12, 13}, False), ("It is so.[P:9]", {12}, False), ("# Heading", set(), True), ("The evidence is: insufficient evidence.", set(), True)])
def test_citations(answer, allowed, valid):
    assert S.check_citations(answer, allowed)["valid"] is valid


def test_uncited_unit_is_named():
    assert S.check_citations("Fact one. Fact two.[P:12]", {12})["uncited"] == ["Fact one."]


def test_short_phrases_match_nothing(spark):
    df = spark.createDataFrame([(1, "ab ab"), (2, "abab")], "id int, body string")
    assert S.bm25(df, "ab", ["body"], "id").count() == 0
    assert S.retrieve(df, "ab", ["body"], "id").count() == 2


def test_overlapping_frequency(spark):
    assert one(spark, S.overlapping_count(F.col("t"), "aaaa"), t="aaaaaa") == 3


def test_surfaces_are_no_patterns(spark):
    for surface in ("\\E", "\\Q", "\\E.\\Q", ".", "$1", "\\"):
        assert one(spark, X.occurrence_starts(F.col("t"), surface), t=f"x{surface}yz{surface}") == [1, 3 + len(surface)]


def test_greedy_overlap(spark):
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((0, 4), (2, 5), (5, 7))])
    assert [tuple(r) for r in one(spark, O.greedy_overlap(spans))] == [(0, 4), (5, 7)]


def test_nearest_gap(spark):
    a = spark.createDataFrame([(1, 1950, 1), (1, 2001, 2)], "k int, sy int, s int")
    b = spark.createDataFrame([(1, 1990, 3), (1, 2011, 4)], "k int, ty int, t int")
    r = O.nearest_gap(a, b, "k", "sy", "ty", "s", "t").first()
    assert (r["gap"], r["s"], r["t"]) == (10, 2, 4)


def test_asof(spark):
    a = spark.createDataFrame([(1, 2022), (1, 2011), (2, 2000)], "k int, y int")
    b = spark.createDataFrame([(1, 2011, "a"), (1, 2017, "b"), (1, 2017, "c")], "k int, y int, id string")
    got = sorted((r["y"], r["right_id"]) for r in O.asof_backward(a, b, "k", "y", "y", "id").collect())
    assert got == [(2022, "c")]


def test_islands(spark):
    rows = [(1, 1), (2, 2), (3, 10), (4, 11), (5, 12), (6, None)]
    df = spark.createDataFrame([(1, p, n) for p, n in rows if n], "d int, page int, printed int").withColumn("offset", F.col("printed") - F.col("page"))
    got = sorted((r["first"], r["last"], r["offset"]) for r in O.islands(df, "d", "page", "offset").collect())
    assert got == [(1, 2, 0), (3, 5, 7)]


def test_closure_stops_at_cycles(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "n string, p string")
    got = {r["node"]: (r["path"], r["cyclic"]) for r in O.closure(spark, df, "n", "p").collect()}
    assert got["c"] == (["a", "b", "c"], False) and got["x"][1] and got["y"][1]


def test_dice_of_long_and_repetitive_texts(spark):
    """As counters have it; and a repetitive text takes time in proportion to its length."""
    def plain(a, b):
        x, y = (Counter(t[i : i + 3] for i in range(len(t) - 2)) for t in (a, b))
        return float(a == b) if max(len(a), len(b)) < 3 else round(2 * (x & y).total() / (x.total() + y.total()), 4)

    rng = random.Random(5)
    made = ["".join(rng.choice("ab\U0001f600é") for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [*zip(made, reversed(made)), ("", ""), ("ab", "ab"), ("ab", "ba"), ("", "abc"), ("a" * 700, "a" * 300)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", X.dice(F.col("a"), F.col("b")).alias("x"))
    assert all(abs(r["x"] - plain(r["a"], r["b"])) < 1.01e-4 for r in df.collect())  # halves are rounded otherwise
    long = spark.range(1).select(F.repeat(F.lit("ab"), 10_000).alias("a"), F.repeat(F.lit("ba"), 10_000).alias("b"))
    began = time.monotonic()
    assert long.select(X.dice(F.col("a"), F.col("b")).alias("x")).first()["x"] == 1.0  # 9,999 of each of two grams
    assert time.monotonic() - began < 20


def test_retry_delays(spark):
    rows = [("k", i, False) for i in range(5)]
    for n, minutes in ((1, 10), (2, 30), (3, 120), (4, 360), (5, None)):
        df = spark.createDataFrame(rows[:n], "key string, s long, ok boolean").select("key", F.timestamp_seconds("s").alias("ts"), "ok")
        r = R.retry_ledger(df).select("attempts", "quarantined", F.unix_timestamp("next_retry_at").alias("at")).first()
        assert r["attempts"] == n and r["quarantined"] == (n >= 5)
        assert r["at"] == (None if minutes is None else n - 1 + 60 * minutes)


def test_retry_stream_needs_no_order(spark, tmp_path):
    """Outcomes of a key in any order, over Arrow batches and over triggers that go back in time, with ties, nulls and times unknown."""
    rng = random.Random(3)
    rows = [(f"k{i % 9}", rng.randrange(40) or None, rng.choice([True, False, False, False, False, None])) for i in range(300)]
    rows += [("undated", None, False), ("undated", 5, False), ("healed", None, False), ("healed", 7, True), ("nothing", 1, None)]
    (df := spark.createDataFrame(rows, "key string, s long, ok boolean").select("key", F.timestamp_seconds("s").alias("ts"), "ok")).repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = latest_of_stream(spark, R.retry_states(stream), "key")
        assert sorted(map(repr, got.select("key", "attempts", "next_retry_at", "quarantined").collect())) == sorted(map(repr, R.retry_ledger(df).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rate_limit(spark):
    df = spark.createDataFrame([(1, i) for i in range(4)], "u int, s long").select("u", F.timestamp_seconds("s").alias("ts"), "s")
    assert [r["accepted"] for r in R.rate_verdicts(df, ["u"], ["s"], 3, 3600).orderBy("s").collect()] == [True, True, True, False]


def test_age_of_null_is_infinite(spark):
    assert math.isinf(one(spark, X.age_seconds(F.current_timestamp(), F.lit(None).cast("timestamp"))))


def test_release_round_trip(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    root = f"file://{tmp_path}/r"
    with pytest.raises(FileNotFoundError):
        read_release(spark, root)
    publish(df, root, ["id"])
    publish(df.filter("id < 5"), root, ["id"])
    assert read_release(spark, root).count() == 5
    with pytest.raises(ValueError):
        publish(df.union(df), root, ["id"])
    assert read_release(spark, root).count() == 5


def test_generated_at(spark):
    a = spark.createDataFrame([(1, "old")], "id int, generated_at string")
    b = spark.createDataFrame([(1, "new")], "id int, generated_at string")
    assert keep_generated_at(a, b).first()["generated_at"] == "old"
    assert keep_generated_at(a.withColumn("id", F.lit(2)), b).first()["generated_at"] == "new"


def test_unicode_functions(spark):
    df = spark.createDataFrame([("ﬁ１",), (None,)], "t string")
    assert [r[0] for r in df.select(X.nfkc("t")).collect()] == ["fi1", None]
    assert df.select(X.hmac_sha256("k")("t")).first()[0] == __import__("hmac").new(b"k", "ﬁ１".encode(), "sha256").hexdigest()
