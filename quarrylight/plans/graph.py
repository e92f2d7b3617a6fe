"""The observation graph and its families over the documents. Query names begin with the operators' ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import graph as G
from quarrylight.session import table as T
from quarrylight.session import written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def q(sql: str | None = None):
    def f(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return f


#: concept, surface, language. "ation" is longer than "tion" and takes its place; "mente" is Spanish only.
LEXICON = [("process", "ation", None), ("state", "tion", None), ("link", "with", "en"), ("manner", "mente", "es")]
FAMILIES = [("process", "deeds"), ("state", "deeds"), ("link", "words"), ("manner", "words")]


def documents(s, d):
    return T(s, d, "documents").withColumn("year", (1990 + F.col("n_chars") % 20).cast("long"))


_C = lambda x: f"((length(text) - length(replace(text, '{x}', ''))) // {len(x)})::BIGINT"
_EPISODES = f"""d AS (SELECT *, 1990 + n_chars % 20 AS year FROM documents), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM d) WHERE r = 1),
p AS (SELECT doc_id, source, year, 'process' AS concept, {_C("ation")} AS k FROM o UNION ALL SELECT doc_id, source, year, 'state', {_C("tion")} - {_C("ation")} FROM o
UNION ALL SELECT doc_id, source, year, 'link', {_C("with")} FROM o WHERE lang = 'en' UNION ALL SELECT doc_id, source, year, 'manner', {_C("mente")} FROM o WHERE lang = 'es'),
c AS (SELECT source, year, sum(n_chars)::BIGINT AS chars FROM o GROUP BY 1, 2),
e AS (SELECT concept, p.source, p.year, sum(k)::BIGINT AS count, count(*) AS documents, arg_min(doc_id, (-k, doc_id)) AS witness FROM p WHERE k > 0 GROUP BY 1, 2, 3),
f AS (SELECT *, round(count / chars * 10000, 4) AS rate FROM e JOIN c USING (source, year)),
eps AS (SELECT substr(sha256(concept || '|' || source || '|' || year), 1, 24) AS id, *, round(0.28 + 0.72 * sqrt(rate / max(rate) OVER (PARTITION BY concept)), 4) AS strength FROM f)"""


@q(f"WITH {_EPISODES} SELECT id, concept, source, year, count, documents, chars, rate, strength, witness FROM eps")
def grf02_episodes(s, d):
    return G.build(documents(s, d), LEXICON, keep=written)[0]


@q(f"""WITH {_EPISODES} SELECT concept, lag(id) OVER (PARTITION BY concept, source ORDER BY year) AS source, id AS target, 'next_year' AS type FROM eps QUALIFY lag(id) OVER (PARTITION BY concept, source ORDER BY year) IS NOT NULL
UNION ALL SELECT concept, lag(id) OVER (PARTITION BY concept, year ORDER BY source), id, 'same_year' FROM eps QUALIFY lag(id) OVER (PARTITION BY concept, year ORDER BY source) IS NOT NULL""")
def grf02_edges(s, d):
    return G.build(documents(s, d), LEXICON, keep=written)[1]


def _families(s, d):
    eps = G.build(documents(s, d), LEXICON, keep=written)[0]
    return G.families(eps, s.createDataFrame(FAMILIES, "concept string, family string"))


_FAMILY = "m(concept, family) AS (VALUES ('process', 'deeds'), ('state', 'deeds'), ('link', 'words'), ('manner', 'words')), x AS (SELECT * FROM eps JOIN m USING (concept))"


@q(f"WITH {_EPISODES}, {_FAMILY} SELECT family, count(*) AS episodes, count(DISTINCT year) AS years, min(year) AS first_year, max(year) AS last_year, sum(count)::BIGINT AS count FROM x GROUP BY 1")
def grf09_family_summary(s, d):
    return _families(s, d)[0]


@q(f"""WITH {_EPISODES}, {_FAMILY}, t AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY family, year ORDER BY strength DESC, count DESC, id) = 1)
SELECT family, lag(id) OVER (PARTITION BY family ORDER BY year) AS source, id AS target FROM t QUALIFY lag(id) OVER (PARTITION BY family ORDER BY year) IS NOT NULL""")
def grf09_family_edges(s, d):
    return _families(s, d)[1]
