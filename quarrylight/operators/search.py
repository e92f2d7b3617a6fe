"""Full-text search: query planning, trigram-phrase matching, BM25, the substring fallback, citations."""

from __future__ import annotations

import re
import unicodedata
import zlib

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import grams
from quarrylight.session import shared_folder, written

#: Shortest and longest phrase taken whole, gram size of longer runs, phrases of a query, rows of a result.
LEAST, WHOLE, GRAM, PHRASES, ROWS = 2, 6, 4, 32, 12
#: Fixed values of BM25: k1, b, and the floor of an idf.
K1, B, FLOOR = 1.2, 0.75, 1e-6


def phrases(query: str) -> list[str]:
    """Runs of Han characters, ASCII letters and digits of the NFKC form; long ones as all 4-grams; distinct, at most 32."""
    out: dict[str, None] = {}
    for run in regex.findall(r"[\p{Script=Han}A-Za-z0-9]+", unicodedata.normalize("NFKC", query)):
        if len(run) < LEAST:
            continue
        for p in [run] if len(run) <= WHOLE else (run[i : i + GRAM] for i in range(len(run) - GRAM + 1)):
            out.setdefault(p)
    return list(out)[:PHRASES]


def fts_query(query: str) -> str:
    """The phrases, quoted and joined by OR."""
    return " OR ".join(f'"{p}"' for p in phrases(query))


def overlapping_count(text: Column, phrase: str) -> Column:
    """Occurrences of a phrase, overlaps counted: one a place, by a look-ahead."""
    return F.regexp_count(text, F.lit(f"(?=\\Q{phrase}\\E)"))


def trigram_length(*fields: Column) -> Column:
    total = F.lit(0)
    for f in fields:
        total = total + F.greatest(F.length(F.coalesce(f, F.lit(""))) - 2, F.lit(0))
    return total


def bm25(docs: DataFrame, query: str, fields: list[str], id: str) -> DataFrame:
    """docs with score, lower is better, for rows that hold a phrase of 3 characters or more (FTS-02, FTS-03).

    Shorter phrases match nothing. One pass gives the statistics and every phrase's document count; a second one scores.
    """
    terms = [p.lower() for p in phrases(query) if len(p) >= 3]
    base = docs.withColumn("__dl", trigram_length(*[F.col(f) for f in fields]))
    if not terms:
        return base.limit(0).withColumn("score", F.lit(0.0)).drop("__dl")
    tf = [sum((overlapping_count(F.lower(F.coalesce(F.col(f), F.lit(""))), t) for f in fields), F.lit(0)) for t in terms]
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.avg("__dl").alias("avgdl"), *[F.count_if(x > 0).alias(f"n{i}") for i, x in enumerate(tf)])
    j = base.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i, x in enumerate(tf):
        idf = F.greatest(F.ln((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(FLOOR))
        score = score - idf * x * (K1 + 1) / (x + K1 * (1 - B + B * F.col("__dl") / F.col("avgdl")))
    hit = F.lit(False)
    for f in fields:
        for t in terms:
            hit |= F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(t))
    return j.filter(hit).withColumn("score", score).select(*docs.columns, "score")


def fallback(docs: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Rows that hold the whole query as a substring, score 0 (FTS-05)."""
    hit = F.lit(False)
    for f in fields:
        hit |= F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(query.strip().lower()))
    return docs.filter(hit).withColumn("score", F.lit(0.0))


def retrieve(docs: DataFrame, query: str, fields: list[str], id: str, limit: int = ROWS, gate: Column | None = None, index: Index | None = None) -> DataFrame:
    """The best rows by BM25; ties by id; substring search where the index finds nothing (FTS-04, FTS-05). Without an index all texts are read."""
    gate = F.lit(True) if gate is None else gate
    limit = min(max(1, limit), ROWS)
    scored = index.bm25(docs, query) if index else bm25(docs, query, fields, id)
    found = scored.filter(gate)
    return found.orderBy("score", id).limit(limit) if found.limit(1).count() else fallback(docs.filter(gate), query, fields).orderBy(id).limit(limit)


class Index:
    """Trigram postings of some fields: for each lower-case trigram the ids of the rows that hold it, and each row's length.

    Postings lie in folders by a hash of the trigram and are sorted by it, so a probe reads a few row groups of a few folders. Rows that hold
    all trigrams of a phrase are candidates; only their texts are read, to verify the phrase and count it.
    """

    _known: dict[tuple, Index] = {}

    def __init__(self, spark: SparkSession, path: str, id: str, kind: str, fields: list[str], buckets: int):
        self.spark, self.path, self.id, self.kind, self.fields, self.buckets = spark, path, id, kind, fields, buckets

    @classmethod
    def build(cls, docs: DataFrame, id: str, fields: list[str], path: str | None = None, buckets: int = 16) -> Index:
        """Ids must be unique."""
        path = path or shared_folder(docs.sparkSession)
        texts = [F.lower(F.coalesce(F.col(f), F.lit(""))) for f in fields]
        rows = docs.select(F.col(id).alias("id"), F.explode(F.array_distinct(F.concat(*[grams(t) for t in texts]))).alias("gram"))
        rows = rows.withColumn("bucket", F.crc32(F.col("gram").cast("binary")) % buckets)
        rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "gram", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
        docs.agg(F.count(F.lit(1)).alias("n"), F.avg(trigram_length(*[F.col(f) for f in fields])).alias("avgdl")).write.parquet(f"{path}/statistics")
        return cls(docs.sparkSession, path, id, docs.schema[id].dataType.simpleString(), fields, buckets)

    @classmethod
    def of(cls, docs: DataFrame, id: str, fields: list[str], name: str) -> Index:
        """The index of a table that does not change, built at its first use in an application."""
        key = (docs.sparkSession.sparkContext.applicationId, name, id, *fields)
        if key not in cls._known:
            cls._known[key] = cls.build(docs, id, fields)
        return cls._known[key]

    def candidates(self, phrases: list[str]) -> DataFrame:
        """id of every row that may hold one of the phrases (of 3 characters or more, lower case): it has all trigrams of one (FTS-02)."""
        parts = {p: sorted({p[i : i + 3] for i in range(len(p) - 2)}) for p in phrases}
        every = sorted({g for gs in parts.values() for g in gs})
        buckets = sorted({zlib.crc32(g.encode()) % self.buckets for g in every})
        held = self.spark.read.schema("id " + self.kind + ", gram string, bucket long").parquet(f"{self.path}/postings").filter(F.col("bucket").isin(buckets) & F.col("gram").isin(every))
        by = held.groupBy("id").agg(F.collect_set("gram").alias("g"))
        some = F.lit(False)
        for gs in parts.values():
            some |= F.size(F.array_intersect("g", F.array(*map(F.lit, gs)))) == len(gs)
        return by.filter(some).select("id")

    def bm25(self, docs: DataFrame, query: str) -> DataFrame:
        """docs with score, lower is better, for rows that hold a phrase (SRC-15, FTS-03); docs: the rows the index was built of, or some of them."""
        terms = [p.lower() for p in phrases(query) if len(p) >= 3]
        if not terms:
            return docs.limit(0).withColumn("score", F.lit(0.0))
        text = [F.lower(F.coalesce(F.col(f), F.lit(""))) for f in self.fields]
        tf = [sum((overlapping_count(x, t) for x in text), F.lit(0)).alias(f"__f{i}") for i, t in enumerate(terms)]
        some = self.candidates(terms).withColumnRenamed("id", self.id)
        hits = docs.join(some, self.id, "left_semi").select("*", trigram_length(*[F.col(f) for f in self.fields]).alias("__dl"), *tf)
        hits = written(hits.filter(F.greatest(F.lit(0), *[F.col(f"__f{i}") for i in range(len(terms))]) > 0).drop(*[f for f in self.fields if f != self.id]))
        stats = self.spark.read.schema("n long, avgdl double").parquet(f"{self.path}/statistics").crossJoin(hits.agg(*[F.count_if(F.col(f"__f{i}") > 0).alias(f"__n{i}") for i in range(len(terms))]))
        j = hits.crossJoin(F.broadcast(stats))  # one row
        score = F.lit(0.0)
        for i in range(len(terms)):
            f, n = F.col(f"__f{i}"), F.col(f"__n{i}")
            idf = F.greatest(F.ln((F.col("n") - n + 0.5) / (n + 0.5)), F.lit(FLOOR))
            score = score - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__dl") / F.col("avgdl")))
        return j.withColumn("score", score).select(*[c for c in docs.columns if c not in self.fields or c == self.id], "score")


def snippet(text: Column, needle: str, before: int = 80, after: int = 140) -> Column:
    """Around the first hit (FTS-08)."""
    at = F.locate(needle.lower(), F.lower(text))
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(text, start, at - start + len(needle) + after))


_CITE = re.compile(r"\[P:([0-9]+)\]")
_ANY_CITE = re.compile(r"\[P:[^\]]*\]")
_END = re.compile(r"(?:(?<![0-9])\.|\.(?![0-9])|[。！？!?])(?:\s*\[P:[^\]]*\])*")
_STRUCTURE = re.compile(r"^\s*(?:#{1,6}\s|[-*_]{3,}\s*$|\|)")
_UNSURE = re.compile(r"(?i)\b(uncertain|unknown|insufficient evidence|not enough evidence|cannot be determined)\b")
_ADVICE = re.compile(r"(?i)^\s*(?:[-*]\s*)?(please|consider|try|you (?:may|might|could)|we suggest)\b")


def sentences(answer: str) -> list[str]:
    """Units of an answer: lines, and sentences with the citations that follow them; a decimal point ends nothing."""
    out = []
    for line in answer.split("\n"):
        at = 0
        for m in _END.finditer(line):
            out.append(line[at : m.end()])
            at = m.end()
        out.append(line[at:])
    return [u.strip() for u in out if u.strip()]


def check_citations(answer: str, allowed: set[int]) -> dict:
    """valid, and the invalid ids, malformed citations and uncited units of an answer (FTS-10)."""
    invalid, malformed, uncited = [], [], []
    for u in sentences(answer):
        good = [int(x) for x in _CITE.findall(u)]
        malformed += [c for c in _ANY_CITE.findall(u) if not _CITE.fullmatch(c)]
        invalid += [i for i in good if i not in allowed]
        bare = _ANY_CITE.sub("", u).strip()
        free = not re.search(r"\w", bare) or _STRUCTURE.match(u) or _UNSURE.search(u) or (_ADVICE.match(u) and not re.search(r"\d", bare))
        if not good and not free:
            uncited.append(u)
    return {"valid": not (invalid or malformed or uncited), "invalid": sorted(set(invalid)), "malformed": malformed, "uncited": uncited}


CITATIONS = "struct<valid: boolean, invalid: array<bigint>, malformed: array<string>, uncited: array<string>>"


def citations_udf():
    """check_citations(answer, allowed ids) over Arrow batches."""
    @F.pandas_udf(CITATIONS)
    def f(answer: pd.Series, allowed: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([check_citations(a or "", set(() if ids is None else ids)) for a, ids in zip(answer, allowed)], columns=["valid", "invalid", "malformed", "uncited"])

    return f
