"""The observation graph: what a lexicon finds in texts, as episodes, edges and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight import functions as X

from . import checks, cols, consecutive, first_per_key, greedy_overlap, rate, require


def occurrences(docs: DataFrame, key: str, text: str, lexicon: Sequence[tuple[str, str, str | None]], scope: str | None = None) -> DataFrame:
    """key, concept, surface, start, end of what a lexicon finds (JOI-11, JOI-12, SCA-06): occurrences of one surface do not overlap, left to right.

    lexicon: (concept, surface, scope or None for any), a configuration of a few hundred entries at most. Only lengths between finds leave
    the scan, never texts; a null text, an empty surface, and a document without finds give no rows. Keys must be unique.
    """

    def lengths(surface: str):
        return F.transform(F.split(text, X.quoted(F.lit(surface)), -1), F.length)

    def entry(concept: str, surface: str, within: str | None):
        here = F.contains(text, F.lit(surface))
        if within is not None:
            here &= F.col(scope) == within
        return F.when(here, F.struct(F.lit(concept).alias("concept"), F.lit(surface).alias("surface"), lengths(surface).alias("gaps")))

    found = F.filter(F.array(*[entry(*x) for x in lexicon if x[1]]), lambda x: x.isNotNull())
    each = docs.select(key, F.inline(found))
    each = each.select(key, "concept", "surface", F.posexplode(F.slice("gaps", 1, F.size("gaps") - 1)).alias("__at", "__gap"))
    size = F.length("surface")
    w = Window.partitionBy(key, "concept", "surface").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    # dealt by key once, which serves this window and those of drop_overlaps
    start = (F.sum("__gap").over(w) + F.col("__at") * size).cast("long")
    return each.repartition(key).select(key, "concept", "surface", start.alias("start")).withColumn("end", F.col("start") + size)


def drop_overlaps(spans: DataFrame, keys, order: Sequence[str]) -> DataFrame:
    """Of half-open spans (start, end) of a key, in order of priority, those that overlap no earlier kept one (JOI-13).

    Only spans of one chain of overlaps meet in an array; order must tell all spans of a key apart.
    """
    k = cols(keys)
    w = Window.partitionBy(*k).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy(*k).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    s = spans.withColumn("__new", F.coalesce(F.col("start") >= F.max("end").over(w), F.lit(True)).cast("long")).withColumn("__chain", F.sum("__new").over(run))
    rest = [c for c in spans.columns if c not in k]
    ordered = F.sort_array(F.collect_list(F.struct(F.struct(*[F.expr(o).alias(f"o{i}") for i, o in enumerate(order)]).alias("__o"), *rest)))
    out = s.groupBy(*k, "__chain").agg(ordered.alias("__all"))
    kept = F.when(F.size("__all") > 1, greedy_overlap(F.col("__all"))).otherwise(F.col("__all"))
    out = out.withColumn("__kept", kept)
    return out.select(*k, F.explode("__kept").alias("x")).select(*k, *[F.col(f"x.{c}") for c in rest])


def episodes(docs: DataFrame, finds: DataFrame, subject: str = "source", year: str = "year") -> DataFrame:
    """One row a concept, subject and year: count, documents, characters, rate, strength, witness, id (GRF-02).

    docs: doc_id, text, n_chars, subject and year; finds: doc_id, concept. A text that several documents share counts in its least doc_id only, for
    counts and denominators (AGG-16, AGG-17). The witness is the document of most finds, the least of these. strength is against the concept's greatest rate (AGG-15).
    """
    n = F.count(F.lit(1))
    own = docs.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.min(F.struct("doc_id", subject, year, "n_chars")).alias("x")).select("x.*")
    chars = own.groupBy(subject, year).agg(F.sum("n_chars").alias("chars"))
    per = finds.groupBy("doc_id", "concept").agg(n.alias("k"))
    e = own.join(per, "doc_id").groupBy("concept", subject, year).agg(F.sum("k").alias("count"), n.alias("documents"), F.min(F.struct((-F.col("k")).alias("k"), "doc_id")).alias("w"))
    e = e.join(chars, [subject, year]).withColumn("rate", rate(F.col("count"), F.col("chars")))
    strength = X.root_strength(F.col("rate"), F.max("rate").over(Window.partitionBy("concept")))
    id = X.compact_id(F.col("concept"), F.col(subject), F.col(year).cast("string"))
    return e.select(id.alias("id"), "concept", subject, year, "count", "documents", "chars", "rate", strength.alias("strength"), F.col("w.doc_id").alias("witness"))


def edges(eps: DataFrame, subject: str = "source", year: str = "year") -> DataFrame:
    """concept, source, target, type: to the next year of a concept and subject, and along the subjects of a concept and year (WIN-01, WIN-02)."""
    eps = eps.select("id", "concept", F.col(subject).alias("__subject"), F.col(year).alias("__year"))  # the subject may be named as an end is
    through = consecutive(eps, ["concept", "__subject"], ["__year"], "id").select("concept", "source", "target", F.lit("next_year").alias("type"))
    across = consecutive(eps, ["concept", "__year"], ["__subject"], "id").select("concept", "source", "target", F.lit("same_year").alias("type"))
    return through.unionAll(across)


def graph_checks(docs: DataFrame, finds: DataFrame, eps: DataFrame, edge: DataFrame, subject: str = "source", year: str = "year") -> DataFrame:
    """check, violations, passed (GAT-11, GAT-14): ids, ends, one concept a path, order, witnesses, ranges, conservation of counts."""
    n = F.count(F.lit(1))
    a, b = (eps.select(F.col("id").alias(end), F.col("concept").alias(f"{end}_concept"), F.struct(year, subject).alias(f"{end}_at"), F.col(subject).alias(f"{end}_subject"), F.col(year).alias(f"{end}_year")) for end in ("source", "target"))
    ends = edge.join(a, "source", "left").join(b, "target", "left")
    along = (F.col("type") == "next_year") & (F.col("source_subject") == F.col("target_subject")) & (F.col("source_year") < F.col("target_year"))
    across = (F.col("type") == "same_year") & (F.col("source_year") == F.col("target_year")) & (F.col("source_subject") < F.col("target_subject"))
    own = docs.groupBy(F.sha2(F.col("text").cast("binary"), 256)).agg(F.min("doc_id").alias("doc_id"))
    want = finds.join(own, "doc_id", "left_semi").groupBy("concept").agg(n.alias("want"))
    got = eps.groupBy("concept").agg(F.sum("count").alias("got"))
    return checks(
        ("unique_episodes", eps.groupBy("id").count().filter("count > 1")),
        ("one_episode_a_cell", eps.groupBy("concept", subject, year).count().filter("count > 1")),
        ("ends_exist", ends.filter("source_concept IS NULL OR target_concept IS NULL")),
        ("ends_of_one_concept", ends.filter("source_concept <> concept OR target_concept <> concept")),
        ("edges_in_order", ends.filter(~F.coalesce(along | across, F.lit(False)))),
        ("unique_edges", edge.groupBy("source", "target", "type").count().filter("count > 1")),
        ("witnesses_have_finds", eps.join(finds.select(F.col("doc_id").alias("witness"), "concept").distinct(), ["witness", "concept"], "left_anti")),
        ("strength_in_range", eps.filter("strength IS NULL OR strength < 0.28 OR strength > 1")),
        ("a_strongest_each", eps.groupBy("concept").agg(F.max("strength").alias("s")).filter("s <> 1")),
        ("counts_conserved", want.join(got, "concept", "full_outer").filter("NOT want <=> got")),
    )


def build(docs: DataFrame, lexicon, subject: str = "source", year: str = "year", scope: str = "lang", keep=None) -> tuple[DataFrame, DataFrame]:
    """Episodes and edges; any check that fails ends the build (GRF-02). keep: DataFrame -> DataFrame, writes what is read several times."""
    keep = keep or (lambda df: df)
    spans = occurrences(docs, "doc_id", "text", lexicon, scope)
    finds = keep(drop_overlaps(spans, "doc_id", ["start - end", "start", "surface", "concept"]).select("doc_id", "concept"))
    eps = keep(episodes(docs, finds, subject, year))
    edge = keep(edges(eps, subject, year))
    require(graph_checks(docs, finds, eps, edge, subject, year).filter("NOT passed"), "observation graph")
    return eps, edge


def families(eps: DataFrame, members: DataFrame, subject: str = "source", year: str = "year") -> tuple[DataFrame, DataFrame]:
    """One row a family: episodes, years, first, last, peak; and its edges: the strongest episode of each year to that of the next (GRF-09).

    members: concept, family; a concept in no family or in several is an error (JOI-10), so is a family without an episode.
    """
    count = members.groupBy("concept").agg(F.count_distinct("family").alias("m"))
    require(eps.select("concept").distinct().join(count, "concept", "left").filter("m IS NULL OR m <> 1"), "concepts of exactly one family")
    present = members.join(eps.select("concept").distinct(), "concept").select("family").distinct()
    require(members.select("family").distinct().join(present, "family", "left_anti"), "families with episodes")
    e = eps.join(members.distinct(), "concept")
    top = first_per_key(e, ["family", year], F.desc("strength"), F.desc("count"), "id")
    summary = e.groupBy("family").agg(F.count(F.lit(1)).alias("episodes"), F.count_distinct(year).alias("years"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.sum("count").alias("count"))
    return summary, consecutive(top, ["family"], [year], "id")
