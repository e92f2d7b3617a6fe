"""Finds, overlaps and checks of the observation graph against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import graph as G

LEXICON = [("a", "aa", None), ("a", "aba", None), ("b", "ab", None), ("c", "ba", "x"), ("d", ".*", None), ("e", "\\E+", None), ("f", "", None)]


def plain(text, lang):
    spans = []
    for concept, surface, scope in LEXICON:
        if not surface or text is None or (scope and scope != lang):
            continue
        at = text.find(surface)
        while at >= 0:
            spans.append((-len(surface), at, surface, concept, at + len(surface)))
            at = text.find(surface, at + len(surface))
    kept = []
    for s in sorted(spans):
        if all(s[1] >= k[4] or s[4] <= k[1] for k in kept):
            kept.append(s)
    return [(s[1], s[4], s[2], s[3]) for s in spans], [(s[1], s[4], s[2], s[3]) for s in kept]


def test_finds_and_overlaps(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("aab.*\\E+ ") for _ in range(rng.choice([0, 5, 40]))), rng.choice(["x", "y", None])) for i in range(60)]
    texts += [(60, None, "x"), (61, "ab" * 3000, "x"), (62, "", "x"), (63, "日aa本aba", "y")]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    found = G.occurrences(df, "doc_id", "text", LEXICON, "lang")
    kept = G.drop_overlaps(found, "doc_id", ["start - end", "start", "surface", "concept"])
    for got, i in ((found, 0), (kept, 1)):
        rows = {(r["doc_id"], r["start"], r["end"], r["surface"], r["concept"]) for r in got.collect()}
        assert rows == {(k, *s) for k, t, lang in texts for s in plain(t, lang)[i]} and len(rows) == got.count()


def test_checks_name_what_is_wrong(spark):
    docs = spark.createDataFrame([(1, "aa ab", 5, "s", 1990, "x"), (2, "aa", 2, "t", 1990, "x"), (3, "aa ab", 5, "t", 1991, "x"), (4, "aa aa", 5, "s", 1992, "x"), (5, None, 0, "s", 1992, None)], "doc_id long, text string, n_chars long, source string, year long, lang string")
    eps, edge = G.build(docs, LEXICON)
    assert sorted((r["concept"], r["source"], r["year"], r["count"], r["witness"]) for r in eps.collect()) == [("a", "s", 1990, 1, 1), ("a", "s", 1992, 2, 4), ("a", "t", 1990, 1, 2), ("b", "s", 1990, 1, 1)]
    assert sorted((r["concept"], r["type"]) for r in edge.collect()) == [("a", "next_year"), ("a", "same_year")]
    finds = G.occurrences(docs, "doc_id", "text", LEXICON, "lang")
    bad = lambda e, x: {r["check"] for r in G.graph_checks(docs, finds, e, x).filter("NOT passed").collect()}
    assert bad(eps, edge) == set()
    assert bad(eps.unionAll(eps.limit(1)), edge) >= {"unique_episodes", "one_episode_a_cell", "counts_conserved"}
    assert bad(eps.filter("year <> 1992"), edge) >= {"ends_exist", "counts_conserved"}
    assert bad(eps, edge.unionAll(edge)) == {"unique_edges"}
    assert bad(eps, edge.select("concept", F.col("target").alias("source"), F.col("source").alias("target"), "type")) == {"edges_in_order"}
    assert "ends_of_one_concept" in bad(eps, edge.withColumn("concept", F.lit("b")))
    assert bad(eps.withColumn("witness", F.lit(5).cast("long")), edge) == {"witnesses_have_finds"}
    assert bad(eps.withColumn("strength", F.col("strength") + 1), edge) == {"strength_in_range", "a_strongest_each"}


def test_families(spark):
    docs = spark.createDataFrame([(1, "aa", 2, "s", 1990, "x"), (2, "ab", 2, "s", 1991, "x")], "doc_id long, text string, n_chars long, source string, year long, lang string")
    eps, _ = G.build(docs, LEXICON)
    members = lambda *m: spark.createDataFrame(list(m), "concept string, family string")
    summary, edges = G.families(eps, members(("a", "f"), ("b", "f"), ("zz", "f")))
    assert [(r["episodes"], r["years"], r["first_year"], r["last_year"]) for r in summary.collect()] == [(2, 2, 1990, 1991)] and edges.count() == 1
    for m, what in ((members(("a", "f")), "exactly one"), (members(("a", "f"), ("a", "g"), ("b", "f")), "exactly one"), (members(("a", "f"), ("b", "f"), ("zz", "g")), "with episodes")):
        with pytest.raises(ValueError, match=what):
            G.families(eps, m)


def test_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long, source string, year long, lang string")
    eps, edge = G.build(docs, LEXICON)
    assert eps.count() == 0 and edge.count() == 0
