"""Composite builders, further gates, sinks and sources. Query names begin with the operators' ids."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight import functions as X
from quarrylight import operators as O
from quarrylight import streaming as R
from quarrylight.operators import jsonschema as J
from quarrylight.session import shared_folder, ship
from quarrylight.session import table as T

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def q(sql: str | None = None):
    def f(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return f


def n():
    return F.count(F.lit(1))


def labelled(s, d, *cols):
    return T(s, d, "documents").select("doc_id", *cols).join(T(s, d, "labels"), "doc_id", "left")


# --- sources and sinks ---------------------------------------------------------------------------


@q("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NOT NULL AS in_base, b.doc_id IS NOT NULL AS in_current FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0) b ON a.doc_id = b.doc_id")
def src18_two_versions(s, d):
    t = T(s, d, "documents").select("doc_id")
    a, b = t.filter("doc_id % 3 <> 0").withColumn("a", F.lit(True)), t.filter("doc_id % 4 <> 0").withColumn("b", F.lit(True))
    return a.join(b, "doc_id", "full_outer").select("doc_id", F.col("a").isNotNull().alias("in_base"), F.col("b").isNotNull().alias("in_current"))


def clamp(text: str | None, low: int, high: int, default: int) -> int:
    """An integer parameter between bounds; anything else is the default (SRC-21)."""
    try:
        return min(high, max(low, int((text or "").strip())))
    except ValueError:
        return default


@q("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 12")
def src21_parameters(s, d):
    return T(s, d, "documents").select("doc_id").orderBy("doc_id").limit(clamp(" 99 ", 1, 12, 8))


@q("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def snk06_replace(s, d):
    return O.first_per_key(T(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", F.desc("o_orderkey"))


@q("""WITH g AS (SELECT p_partkey, lower(substr(p_name, i, 3)) AS gram FROM (SELECT p_partkey, p_name, unnest(range(1, greatest(length(p_name) - 1, 1))) AS i FROM part)) SELECT gram, count(DISTINCT p_partkey) AS rows, count(*) AS tf FROM g GROUP BY 1""")
def snk10_trigram_index(s, d):
    """The inverted index, recomputed from its base table."""
    g = T(s, d, "part").select("p_partkey", F.explode(X.grams(F.lower("p_name"))).alias("gram"))
    return g.groupBy("gram").agg(F.count_distinct("p_partkey").alias("rows"), n().alias("tf"))


@q("SELECT count(*) AS rows FROM region")
def str10_exactly_once(s, d):
    """A chunk that arrives again is still there once."""
    sink = R.Receipts(shared_folder(s))
    for batch in (0, 0):
        sink(T(s, d, "region"), batch)
    return sink.read(s).agg(n().alias("rows"))


@q("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)")
def str15_resumable_work(s, d):
    done = T(s, d, "labels").filter("quality IS NOT NULL")
    return T(s, d, "documents").select("doc_id").join(done, "doc_id", "left_anti")


@q("SELECT o_orderkey, year(o_orderdate) AS issued, year(o_orderdate + INTERVAL 1 YEAR) AS revised FROM orders")
def sca09_edition_years(s, d):
    text = F.concat(F.lit("issued "), F.year("o_orderdate").cast("string"), F.lit(", revised "), (F.year("o_orderdate") + 1).cast("string"))
    year = lambda w: F.regexp_extract(text, rf"{w} ([0-9]{{4}})", 1).cast("long")
    return T(s, d, "orders").select("o_orderkey", year("issued").alias("issued"), year("revised").alias("revised"))


@q("SELECT p_partkey, regexp_extract(p_type, '^(\\S+)', 1) AS subject FROM part")
def sca14_subject_from_title(s, d):
    return T(s, d, "part").select("p_partkey", F.regexp_extract("p_type", r"^(\S+)", 1).alias("subject"))


# --- gates ---------------------------------------------------------------------------------------


@q("""SELECT doc_id, CASE WHEN quality IS NOT NULL THEN 'subject' ELSE 'scope' END AS kind, (quality IS NOT NULL AND toxic IS NOT NULL) OR (quality IS NULL AND toxic IS NULL) AS sound FROM documents LEFT JOIN labels USING (doc_id)""")
def gat10_classification(s, d):
    """A tagged union: a subject row has both labels, a scope row neither."""
    a, b = F.col("quality").isNotNull(), F.col("toxic").isNotNull()
    return labelled(s, d).select("doc_id", F.when(a, "subject").otherwise("scope").alias("kind"), ((a & b) | (~a & ~b)).alias("sound"))


@q("""SELECT 'unique' AS "check", (SELECT count(*) FROM (SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1)) AS violations UNION ALL SELECT 'referential', (SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region))
UNION ALL SELECT 'coverage', (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)) UNION ALL SELECT 'range', (SELECT count(*) FROM part WHERE p_size < 1 OR p_size > 50)""")
def gat12_data_quality(s, d):
    p, nat = T(s, d, "part"), T(s, d, "nation")
    out = O.checks(
        ("unique", p.groupBy("p_partkey").count().filter("count > 1")),
        ("referential", nat.join(T(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left_anti")),
        ("coverage", nat.join(T(s, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left_anti")),
        ("range", p.filter("p_size < 1 OR p_size > 50")),
    )
    return out.select("check", "violations")


@q("""SELECT 'source' AS endpoint, count(*) AS missing FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'target', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)""")
def gat14_graph_contract(s, d):
    li = T(s, d, "lineitem")
    a = li.join(T(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").agg(n().alias("missing")).select(F.lit("source").alias("endpoint"), "missing")
    return a.unionAll(li.join(T(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left_anti").agg(n().alias("missing")).select(F.lit("target").alias("endpoint"), "missing"))


@q("SELECT o_orderkey, count(l_orderkey) AS actual, max(l_linenumber) AS declared, count(l_orderkey) = max(l_linenumber) AS equal FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def gat18_declared_counts(s, d):
    j = T(s, d, "orders").join(T(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("actual"), F.max("l_linenumber").cast("long").alias("declared")).select("*", (F.col("actual") == F.col("declared")).alias("equal"))


@q("""SELECT bool_and(v = 0) AS ready FROM (SELECT count(*) AS v FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT count(*) FROM orders WHERE o_orderstatus IS NULL)""")
def gat19_finalize(s, d):
    """All invariants in one verdict: any frame that should be empty and is not closes the release."""
    o, c = T(s, d, "orders"), T(s, d, "customer")
    frames = O.checks(
        ("orders_have_customers", o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti")),
        ("customers_have_nations", c.join(T(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left_anti")),
        ("status_present", o.filter("o_orderstatus IS NULL")),
    )
    return frames.agg(F.bool_and("passed").alias("ready"))


EVENT_SCHEMA = {
    "type": "object", "required": ["id", "kind"], "additionalProperties": False,
    "properties": {"id": {"type": "integer", "minimum": 0}, "kind": {"$ref": "#/definitions/kind"}, "value": {"type": ["number", "null"], "maximum": 90}},
    "definitions": {"kind": {"enum": ["click", "view", "purchase"]}},
}


@q("SELECT event_id, (NOT event_type IN ('click', 'view', 'purchase'))::INT + (value > 90)::INT AS errors FROM events")
def gat24_json_schema(s, d):
    ship(s)
    text = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value"))
    return T(s, d, "events").select("event_id", F.size(J.errors_udf(EVENT_SCHEMA)(text)).alias("errors"))


@q("SELECT sha256(text) AS sha, count(DISTINCT source) AS witnesses, count(DISTINCT source) - 1 AS mirrors FROM documents GROUP BY 1 HAVING count(*) > 1")
def gat25_independent_evidence(s, d):
    """Mirrors of one artifact are one piece of evidence."""
    t = T(s, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "source")
    return t.groupBy("sha").agg(n().alias("c"), F.count_distinct("source").alias("witnesses")).filter("c > 1").select("sha", "witnesses", (F.col("witnesses") - 1).alias("mirrors"))


# --- composite builders --------------------------------------------------------------------------


@q("""SELECT doc_id, split_part(text, chr(10), 1) AS heading, length(split_part(text, chr(10), 1)) AS width FROM documents WHERE contains(substr(text, 1, 1200), 'tion') AND length(split_part(text, chr(10), 1)) <= 200""")
def grf03_page_fragments(s, d):
    head = F.split_part("text", F.lit("\n"), F.lit(1))
    t = T(s, d, "documents").filter(F.contains(F.substring("text", 1, 1200), F.lit("tion")) & (F.length(head) <= 200))
    return t.select("doc_id", head.alias("heading"), F.length(head).cast("long").alias("width"))


@q("""WITH x AS (SELECT o_custkey AS line, year(o_orderdate) AS y, o_orderkey AS id, o_totalprice AS v FROM orders), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line, y ORDER BY v DESC, id) AS r FROM x) WHERE r = 1)
SELECT line, y, id, coalesce(lead(y) OVER (PARTITION BY line ORDER BY y) - 1, 1999) AS until, lag(id) OVER (PARTITION BY line ORDER BY y) AS previous FROM best""")
def grf04_star_projection(s, d):
    x = T(s, d, "orders").select(F.col("o_custkey").alias("line"), F.year("o_orderdate").alias("y"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    best = O.lead_ranges(O.first_per_key(x, ["line", "y"], F.desc("v"), "id"), "line", "y", F.lit(1999))
    return best.select("line", "y", "id", F.col("range_end").alias("until"), F.lag("id").over(Window.partitionBy("line").orderBy("y")).alias("previous"))


@q("SELECT p_partkey, concept FROM part, (VALUES ('STEEL'), ('BRASS')) c(concept) WHERE contains(p_type, concept) AND p_size IN (1, 2, 3, 4, 5)")
def grf05_title_observations(s, d):
    found = F.filter(F.array(F.lit("STEEL"), F.lit("BRASS")), lambda c: F.contains(F.col("p_type"), c))
    return T(s, d, "part").filter(F.array_contains(F.array(*map(F.lit, range(1, 6))), F.col("p_size"))).select("p_partkey", F.explode(found).alias("concept"))


@q("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), m AS (SELECT doc_id, i, ((length(line) - length(replace(line, 'tion', ''))) / 4)::BIGINT AS k FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, i) AS rank FROM m WHERE k > 0) SELECT doc_id, i AS page, k AS mentions, rank FROM r WHERE rank <= 6""")
def grf06_subject_detail(s, d):
    l = T(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    m = l.select("doc_id", (F.col("p") + 1).cast("long").alias("page"), X.exact_count(F.col("line"), "tion").cast("long").alias("mentions")).filter("mentions > 0")
    return O.top_k(m, "doc_id", 6, F.desc("mentions"), "page")


@q("""WITH a AS (SELECT o_custkey AS k, o_orderkey AS id, 1 AS p FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey, o_orderkey, 2 FROM orders WHERE o_totalprice > 100000), c AS (SELECT o_custkey, o_orderkey, 3 FROM orders WHERE o_orderpriority LIKE '1%'),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) SELECT id, min(p) AS origin, count(*) AS sources FROM u GROUP BY id""")
def grf07_bounded_items(s, d):
    """Items of three sources; the first source that has one is its origin."""
    o = T(s, d, "orders")
    parts = [o.filter(f).select(F.col("o_orderkey").alias("id"), F.lit(i).alias("p")) for i, f in enumerate(("o_orderstatus = 'F'", "o_totalprice > 100000", "o_orderpriority LIKE '1%'"), 1)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("id").agg(F.min("p").alias("origin"), n().alias("sources"))


@q("""WITH c AS (SELECT doc_id, ((length(text) - length(replace(text, 'tion', ''))) / 4)::BIGINT AS a, ((length(text) - length(replace(text, 'with', ''))) / 4)::BIGINT AS b, n_chars FROM documents WHERE lang = 'en')
SELECT doc_id, round(a / n_chars * 10000, 4) AS rate, least(a, b) AS together FROM c WHERE n_chars > 0""")
def grf08_single_document_layer(s, d):
    t = T(s, d, "documents").filter("lang = 'en' AND n_chars > 0")
    c = t.select("doc_id", "n_chars", *[X.exact_count(F.col("text"), w).cast("long").alias(k) for k, w in (("a", "tion"), ("b", "with"))])
    return c.select("doc_id", O.rate(F.col("a"), F.col("n_chars")).alias("rate"), F.least("a", "b").alias("together"))
