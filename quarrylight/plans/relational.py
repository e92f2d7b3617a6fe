"""Filters, projections, joins, sorts and set operations over the star schema and the documents. Query names begin with the operators' ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight import functions as X
from quarrylight import operators as O
from quarrylight.operators import graph as G
from quarrylight.operators.related import related_items
from quarrylight.session import table as T
from quarrylight.session import written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def q(sql: str | None = None):
    """Register a query under its function's name, with its DuckDB twin."""

    def f(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return f


# --- projections and filters ---------------------------------------------------------------------


@q("SELECT c_custkey AS id, upper(c_name) AS label, c_acctbal AS balance FROM customer")
def prj01_projection(s: SparkSession, d: str) -> DataFrame:
    return T(s, d, "customer").select(F.col("c_custkey").alias("id"), F.upper("c_name").alias("label"), F.col("c_acctbal").alias("balance"))


@q("""SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' END, CASE WHEN l.quality = 1 THEN 'good' END, d.source) AS label
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def prj02_label_coalesce(s, d):
    j = T(s, d, "documents").select("doc_id", "source").join(T(s, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 1, "good"), "source").alias("label"))


@q("""SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey)[1] AS first_order, count(*) AS n_orders FROM orders GROUP BY o_custkey""")
def prj03_core_projection(s, d):
    g = T(s, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("ids"))
    return g.select("o_custkey", F.slice("ids", 1, 1)[0].alias("first_order"), F.size("ids").cast("long").alias("n_orders"))


@q("SELECT doc_id, lang, n_chars FROM documents")
def prj04_sanitized(s, d):
    allowed = ["doc_id", "lang", "n_chars"]  # no text, no source leaves
    return T(s, d, "documents").select(*allowed)


@q("SELECT count(*) AS differences FROM (SELECT o_orderkey, o_custkey FROM orders EXCEPT ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority IS NOT NULL)")
def prj05_identity_without_volatile(s, d):
    a = T(s, d, "orders").drop("o_orderdate", "o_orderstatus", "o_totalprice", "o_orderpriority")
    b = T(s, d, "orders").filter("o_orderpriority IS NOT NULL").select("o_orderkey", "o_custkey")
    return O.both_ways(a, b).agg(F.count(F.lit(1)).alias("differences"))


def optional(c, value: str):
    """A predicate that an empty parameter switches off (FLT-01)."""
    return F.lit(True) if value == "" else F.col(c) == value


@q("SELECT doc_id FROM documents WHERE ('' = '' OR source = '') AND ('fr' = '' OR lang = 'fr')")
def flt01_optional_parameters(s, d):
    return T(s, d, "documents").filter(optional("source", "") & optional("lang", "fr")).select("doc_id")


@q("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src11')")
def flt02_alias_in_list(s, d):
    alias = {"first": ["src1", "src11"]}
    return T(s, d, "documents").filter(F.col("source").isin(*alias["first"])).select("doc_id", "source")


@q("SELECT doc_id FROM documents WHERE source = 'src2' AND EXISTS (SELECT 1 FROM documents WHERE source = 'src2')")
def flt03_validated_value(s, d):
    docs = T(s, d, "documents")
    known = docs.filter(F.col("source") == "src2")
    if known.limit(1).count() == 0:
        raise ValueError("unknown source 'src2'")
    return known.select("doc_id")


@q("SELECT event_id FROM events WHERE ts::DATE = (SELECT max(ts)::DATE FROM events)")
def flt04_scalar_subquery(s, d):
    T(s, d, "events").createOrReplaceTempView("events")
    return s.sql("SELECT event_id FROM events WHERE CAST(ts AS DATE) = (SELECT CAST(max(ts) AS DATE) FROM events)")


@q("""SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'O' AND o_orderstatus = 'O'""")
def flt05_two_level_gate(s, d):
    return T(s, d, "lineitem").join(T(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).filter("l_linestatus = 'O' AND o_orderstatus = 'O'").select("l_orderkey", "l_linenumber")


@q("SELECT p_partkey FROM part WHERE contains(lower(p_name), lower('%A')) OR contains(lower(p_type), lower('BRASS'))")
def flt06_like_escaped(s, d):
    return T(s, d, "part").filter(F.contains(F.lower("p_name"), F.lit("%a")) | F.contains(F.lower("p_type"), F.lit("brass"))).select("p_partkey")


@q("""SELECT event_id FROM events WHERE props LIKE '%"page"%' OR event_type = 'click'""")
def flt07_json_membership(s, d):
    e = T(s, d, "events")
    keys = F.json_object_keys("props")
    return e.filter(F.coalesce(F.array_contains(keys, "page"), F.lit(False)) | (F.col("event_type") == "click")).select("event_id")


@q("""SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_orderpriority LIKE '1%' THEN 'urgent' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS class FROM orders""")
def flt08_case_mapping(s, d):
    c = F.when(F.col("o_totalprice") > 300000, "large").when(F.col("o_orderpriority").startswith("1"), "urgent").when(F.col("o_totalprice") > 100000, "medium").otherwise("small")
    return T(s, d, "orders").select("o_orderkey", c.alias("class"))


@q("""SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM l.toxic""")
def flt09_null_safe_inequality(s, d):
    j = T(s, d, "documents").select("doc_id").join(T(s, d, "labels"), "doc_id", "left")
    return j.filter(~F.col("quality").eqNullSafe(F.col("toxic"))).select("doc_id")


@q("""SELECT 'enum' AS rule, count(*) AS violations FROM orders WHERE o_orderstatus NOT IN ('O', 'F', 'P')
UNION ALL SELECT 'implication', count(*) FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'R'
UNION ALL SELECT 'range', count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 1""")
def flt10_check_constraints(s, d):
    o, li = T(s, d, "orders"), T(s, d, "lineitem")
    out = O.checks(
        ("enum", o.filter(~F.col("o_orderstatus").isin("O", "F", "P"))),
        ("implication", li.filter("l_linestatus = 'O' AND l_returnflag = 'R'")),
        ("range", li.filter("l_discount < 0 OR l_discount > 1")),
    )
    return out.select(F.col("check").alias("rule"), "violations")


@q("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE length(line) BETWEEN 24 AND 2200 AND len(regexp_extract_all(line, '[A-Za-z0-9]')) > 0.55 * length(line)) AS useful FROM l GROUP BY doc_id""")
def flt11_useful_blocks(s, d):
    n = F.length("line")
    useful = n.between(24, 2200) & (X.meaningful_characters(F.col("line"), "[A-Za-z0-9]") > 0.55 * n)
    lines = T(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(useful).alias("useful"))


@q("""SELECT o_orderkey FROM orders WHERE (year(o_orderdate) IN (1995, 1996)) AND NOT (o_orderpriority IN ('5-LOW')) AND contains(lower(o_orderstatus || ' ' || o_orderpriority), 'o')""")
def flt12_visibility(s, d):
    years, hidden, query = [1995, 1996], ["5-LOW"], "o"
    p = F.year("o_orderdate").isin(years) if years else F.lit(True)
    p &= ~F.arrays_overlap(F.array("o_orderpriority"), F.array(*map(F.lit, hidden))) if hidden else F.lit(True)
    p &= F.contains(F.lower(F.concat_ws(" ", "o_orderstatus", "o_orderpriority")), F.lit(query))
    return T(s, d, "orders").filter(p).select("o_orderkey")


@q("""SELECT doc_id, CASE WHEN source = 'src3' THEN lang ELSE source END AS facet FROM documents WHERE CASE WHEN source = 'src3' THEN lang IN ('en') ELSE source IN ('src4', 'src5') END""")
def flt13_persisted_facet(s, d):
    legacy = F.col("source") == "src3"
    return T(s, d, "documents").filter(F.when(legacy, F.col("lang").isin("en")).otherwise(F.col("source").isin("src4", "src5"))).select("doc_id", F.when(legacy, F.col("lang")).otherwise(F.col("source")).alias("facet"))


@q("""SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'steel')""")
def flt14_multi_field_search(s, d):
    return T(s, d, "part").filter(F.contains(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), F.lit("steel"))).select("p_partkey")


ERAS = [("early", 1992, 1993), ("middle", 1994, 1996), ("late", 1997, 1999)]


@q("""WITH e(era, a, b) AS (VALUES ('early', 1992, 1993), ('middle', 1994, 1996), ('late', 1997, 1999))
SELECT era, count(*) AS n FROM orders JOIN e ON year(o_orderdate) BETWEEN a AND b WHERE o_orderstatus = 'F' GROUP BY era""")
def flt15_archive_by_era(s, d):
    o = T(s, d, "orders").filter("o_orderstatus = 'F'").select(F.year("o_orderdate").alias("y"))
    eras = s.createDataFrame(ERAS, "era string, a int, b int")
    return O.range_join(o, eras, "y", "a", "b", 10).groupBy("era").agg(F.count(F.lit(1)).alias("n"))


@q("""SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND value > 50""")
def flt16_lifecycle_filter(s, d):
    visible, every = ["click", "view"], ["click", "view", "purchase", "login", "logout"]
    p = F.lit(True) if set(visible) == set(every) else F.arrays_overlap(F.array("event_type"), F.array(*map(F.lit, visible)))
    return T(s, d, "events").filter(p & (F.col("value") > 50)).select("event_id", "event_type")


@q("SELECT count(*) AS columns FROM (DESCRIBE documents) WHERE column_name IN ('doc_id', 'text', 'lang', 'source', 'n_chars')")
def flt17_structural_keys(s, d):
    allowed = {"doc_id", "text", "lang", "source", "n_chars"}
    docs = T(s, d, "documents")
    if extra := set(docs.columns) - allowed:
        raise ValueError(f"unknown columns: {sorted(extra)}")
    return s.createDataFrame([(len(docs.columns),)], "columns long")


@q("""WITH r AS (SELECT doc_id, list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END,
  CASE WHEN l.quality IS NULL THEN 'unlabelled' END, CASE WHEN l.toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS reasons FROM documents LEFT JOIN labels l USING (doc_id)),
e AS (SELECT doc_id, unnest(CASE WHEN len(reasons) = 0 THEN ['eligible'] ELSE reasons END) AS reason FROM r)
SELECT reason, count(*) AS n FROM e GROUP BY reason""")
def flt18_reason_codes(s, d):
    j = T(s, d, "documents").select("doc_id", "n_chars", "lang").join(T(s, d, "labels"), "doc_id", "left")
    r = O.reasons(short=F.col("n_chars") < 200, foreign=F.col("lang") != "en", unlabelled=F.col("quality").isNull(), toxic=F.col("toxic") == 1)
    e = j.select(F.explode(F.when(F.size(r) == 0, F.array(F.lit("eligible"))).otherwise(r)).alias("reason"))
    return e.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# --- joins ---------------------------------------------------------------------------------------


@q("""SELECT n_name, r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""")
def joi01_inner_chain(s, d):
    j = T(s, d, "orders").join(T(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(T(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(T(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@q("""SELECT count(*) AS rows, count(l_orderkey) AS matched, count(DISTINCT CASE WHEN l_orderkey IS NULL THEN o_orderkey END) AS without_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""")
def joi02_left_counts(s, d):
    j = T(s, d, "orders").join(T(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.agg(F.count(F.lit(1)).alias("rows"), F.count("l_orderkey").alias("matched"), F.count_distinct(F.when(F.col("l_orderkey").isNull(), F.col("o_orderkey"))).alias("without_lines"))


@q("""SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS lines, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def joi03_nested_children(s, d):
    j = T(s, d, "orders").select("o_orderkey").join(T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    g = j.groupBy("o_orderkey").agg(F.sort_array(F.collect_list(F.when(F.col("l_orderkey").isNotNull(), F.struct("l_linenumber", "l_partkey")))).alias("lines"))
    return g.select("o_orderkey", F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("lines"), F.size("lines").cast("long").alias("n"))


@q("""SELECT a.n_name AS source, b.n_name AS target FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def joi04_role_playing(s, d):
    n = T(s, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("source"), F.col("b.n_name").alias("target"))


@q("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def joi05_semi(s, d):
    return T(s, d, "customer").join(T(s, d, "orders").filter("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@q("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def joi06_anti(s, d):
    return T(s, d, "orders").join(T(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@q("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def joi07_in_subquery(s, d):
    return s.sql("SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_returnflag = 'R')", part=T(s, d, "part"), lineitem=T(s, d, "lineitem"))


@q("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def joi08_lookup(s, d):
    nation = T(s, d, "nation")  # a fixed dimension of 25 rows
    return T(s, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@q("""SELECT doc_id, source, CASE WHEN doc_id % 10 = 0 THEN 'special' WHEN source IN ('src1', 'src2') THEN 'core' ELSE 'unclassified' END AS class,
CASE WHEN doc_id % 10 = 0 THEN 'override' WHEN source IN ('src1', 'src2') THEN 'rule' ELSE 'default' END AS basis FROM documents""")
def joi09_override_lookup(s, d):
    docs = T(s, d, "documents").select("doc_id", "source")
    override = docs.filter("doc_id % 10 = 0").select("doc_id", F.lit("special").alias("class"))
    rules = s.createDataFrame([("src1", "core"), ("src2", "core")], "source string, class string")
    return O.override_lookup(docs, override, rules, "doc_id", "source", "class", "unclassified")


@q("""WITH g(grp, m) AS (VALUES ('a', 'en'), ('a', 'fr'), ('b', 'de'), ('b', 'en')) SELECT lang, count(grp) AS matches FROM (SELECT DISTINCT lang FROM documents) LEFT JOIN g ON lang = m GROUP BY lang HAVING count(grp) <> 1""")
def joi10_exactly_one(s, d):
    groups = s.createDataFrame([("a", ["en", "fr"]), ("b", ["de", "en"])], "grp string, members array<string>").select("grp", F.explode("members").alias("lang"))
    return O.not_exactly_one(T(s, d, "documents").select("lang").distinct(), "lang", groups, "lang")


SCOPES = [("c1", ["*"]), ("c2", ["en"]), ("c3", ["de", "src1"])]


@q("""WITH c(concept, scope) AS (VALUES ('c1', ['*']), ('c2', ['en']), ('c3', ['de', 'src1']))
SELECT concept, count(*) AS n FROM documents JOIN c ON list_contains(scope, '*') OR list_contains(scope, lang) OR list_contains(scope, source) GROUP BY concept""")
def joi11_wildcard_scope(s, d):
    c = s.createDataFrame(SCOPES, "concept string, scope array<string>").select("concept", F.explode("scope").alias("m"))
    docs = T(s, d, "documents").select("doc_id", F.explode(F.array_distinct(F.array(F.lit("*"), "lang", "source"))).alias("m"))
    return docs.join(c, "m").select("concept", "doc_id").distinct().groupBy("concept").agg(F.count(F.lit(1)).alias("n"))


LEXICON = ["tion", "the", "and", "with", "ble"]


@q("""WITH l(surface) AS (VALUES ('tion'), ('the'), ('and'), ('with'), ('ble'))
SELECT doc_id, surface, ((length(text) - length(replace(text, surface, ''))) / length(surface))::BIGINT AS n FROM documents, l WHERE contains(text, surface)""")
def joi12_substring_join(s, d):
    docs = T(s, d, "documents").select("doc_id", "text")
    counts = F.array(*[F.struct(F.lit(x).alias("surface"), X.exact_count(F.col("text"), x).cast("long").alias("n")) for x in LEXICON])
    return docs.select("doc_id", F.inline(F.filter(counts, lambda c: c["n"] > 0)))


@q()
def joi13_greedy_overlap(s, d):
    """Longest match first, then start, then surface; kept spans of each document."""
    docs = T(s, d, "documents").select("doc_id", "text")
    spans = written(G.occurrences(docs, "doc_id", "text", [(x, x, None) for x in [*LEXICON, "ation", "then"]]))
    count = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias(name))
    j = docs.select("doc_id").join(count(G.drop_overlaps(spans, "doc_id", ["start - end", "start", "surface"]), "kept"), "doc_id", "left").join(count(spans, "found"), "doc_id", "left")
    return j.select("doc_id", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("found", F.lit(0)).alias("found"))


@q("""WITH e(era, a, b) AS (VALUES ('early', 1992, 1993), ('middle', 1994, 1996), ('late', 1997, 1999)), y AS (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)
SELECT o_orderkey, era FROM y JOIN e ON y BETWEEN a AND b""")
def joi14_range_join(s, d):
    o = T(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    return O.range_join(o, s.createDataFrame(ERAS, "era string, a int, b int"), "y", "a", "b", 10).select("o_orderkey", "era")


@q("""WITH p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'click'),
j AS (SELECT p.event_id, p.user_id, c.event_id AS click_id, row_number() OVER (PARTITION BY p.event_id ORDER BY c.ts DESC, c.event_id::VARCHAR DESC) AS n FROM p JOIN c ON p.user_id = c.user_id AND c.ts < p.ts)
SELECT event_id, user_id, click_id FROM j WHERE n = 1""")
def joi15_asof_backward(s, d):
    e = T(s, d, "events").select("user_id", "event_id", "ts", "event_type")
    p, c = (e.filter(F.col("event_type") == x).drop("event_type") for x in ("purchase", "click"))
    return O.asof_backward(p, c, "user_id", "ts", "ts", "event_id").select("event_id", "user_id", F.col("right_event_id").alias("click_id"))


@q("""WITH a AS (SELECT o_custkey, o_orderkey, year(o_orderdate) AS y FROM orders), j AS (
SELECT s.o_custkey, s.o_orderkey AS source, t.o_orderkey AS target, t.y - s.y AS gap, row_number() OVER (PARTITION BY s.o_custkey ORDER BY t.y - s.y, s.y DESC, s.o_orderkey, t.o_orderkey) AS n
FROM a s JOIN a t ON s.o_custkey = t.o_custkey AND s.o_orderkey % 2 = 0 AND t.o_orderkey % 2 = 1 WHERE t.y >= s.y) SELECT o_custkey, source, target, gap FROM j WHERE n = 1""")
def joi16_nearest_gap(s, d):
    o = T(s, d, "orders").select("o_custkey", "o_orderkey", F.year("o_orderdate").alias("y"))
    a = o.filter("o_orderkey % 2 = 0").select("o_custkey", F.col("o_orderkey").alias("source"), F.col("y").alias("sy"))
    b = o.filter("o_orderkey % 2 = 1").select("o_custkey", F.col("o_orderkey").alias("target"), F.col("y").alias("ty"))
    return O.nearest_gap(a, b, "o_custkey", "sy", "ty", "source", "target").select("o_custkey", "source", "target", "gap")


@q("""WITH b AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT a.p_brand AS left_id, b.p_brand AS right_id, count(*) AS n FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, left_id, right_id LIMIT 160""")
def joi17_cooccurrence(s, d):
    b = T(s, d, "lineitem").join(T(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand").distinct()
    return O.pairs(b, "l_orderkey", "p_brand").orderBy(F.desc("n"), "left_id", "right_id").limit(160)


@q("""WITH b AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT a.p_brand AS left_id, b.p_brand AS right_id, min(a.l_orderkey) AS first_order FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.p_brand < b.p_brand GROUP BY 1, 2""")
def joi18_first_witness(s, d):
    b = T(s, d, "lineitem").join(T(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand").distinct()
    x, y = b.withColumnRenamed("p_brand", "left_id"), b.withColumnRenamed("p_brand", "right_id")
    return x.join(y, "l_orderkey").filter("left_id < right_id").groupBy("left_id", "right_id").agg(F.min("l_orderkey").alias("first_order"))


@q("""WITH x AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, year(o_orderdate) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
c AS (SELECT a.o AS item, b.o AS related, count(*) AS shared, min(abs(a.y - b.y)) AS distance FROM x a JOIN x b ON a.p = b.p AND a.o <> b.o GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY shared DESC, distance, related) AS rank FROM c) SELECT item, related, shared, distance, rank FROM r WHERE rank <= 6""")
def joi19_related_items(s, d):
    lines = T(s, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("member"))
    places = T(s, d, "orders").select(F.col("o_orderkey").alias("item"), F.year("o_orderdate").alias("place"))
    year = F.coalesce("place", F.lit(-(2**31)))
    per_order = places.dropna(subset=["item"]).groupBy("item").agg(F.min(year).alias("least"), F.max(year).alias("most"))
    if per_order.filter(f"least <> most OR least = {-(2**31)}").isEmpty():
        return related_items(lines, places, 6)
    # an order without a date, or dated twice: all pairs
    x = lines.join(places, "item").distinct()
    a, b = x.select("member", "item", F.col("place").alias("ya")), x.select("member", F.col("item").alias("related"), F.col("place").alias("yb"))
    c = a.join(b, "member").filter("item <> related").groupBy("item", "related").agg(F.count(F.lit(1)).alias("shared"), F.min(F.abs(F.col("ya") - F.col("yb"))).alias("distance"))
    return O.top_k(c, "item", 6, F.desc("shared"), F.asc_nulls_last("distance"), "related")


@q("""WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 13 <> 0),
j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderkey AS x, b.o_orderkey AS y, (a.o_orderstatus IS DISTINCT FROM b.o_orderstatus) AS c1, (a.o_totalprice IS DISTINCT FROM b.o_totalprice) AS c2 FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT o_orderkey, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' WHEN c1 OR c2 THEN 'updated' ELSE 'unchanged' END AS change,
CASE WHEN x IS NULL OR y IS NULL THEN '' ELSE concat_ws(',', CASE WHEN c1 THEN 'o_orderstatus' END, CASE WHEN c2 THEN 'o_totalprice' END) END AS changed_fields FROM j""")
def joi20_full_outer_diff(s, d):
    o = T(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    a = o.filter("o_orderkey % 7 <> 0")
    b = o.filter("o_orderkey % 13 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 11 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    return O.diff(a, b, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@q("""WITH s AS (SELECT c_nationkey AS n, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer)
SELECT h.n, h.c_custkey AS hub, m.c_custkey AS member FROM s h JOIN s m ON h.n = m.n WHERE h.r = 1 AND m.r BETWEEN 2 AND 4""")
def joi21_hub_star(s, d):
    r = O.top_k(T(s, d, "customer").select(F.col("c_nationkey").alias("n"), "c_custkey", "c_acctbal"), "n", 4, F.desc("c_acctbal"), "c_custkey")
    return r.filter("rank = 1").select("n", F.col("c_custkey").alias("hub")).join(r.filter("rank > 1").select("n", F.col("c_custkey").alias("member")), "n")


@q("""SELECT l_linestatus AS mode, count(*) AS edges FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def joi22_endpoint_resolution(s, d):
    e = T(s, d, "lineitem").select("l_partkey", "l_suppkey", F.col("l_linestatus").alias("mode"))
    return e.join(T(s, d, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey").join(T(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey").groupBy("mode").agg(F.count(F.lit(1)).alias("edges"))


@q("""WITH u AS (SELECT sha256(text) AS sha, 'documents' AS src FROM documents UNION ALL SELECT sha256(text), 'benchmark' FROM benchmark UNION ALL SELECT sha256(text), 'conversations' FROM conversations UNION ALL SELECT sha256(html), 'pages' FROM pages)
SELECT sha, count(*) AS refs, CASE WHEN count(DISTINCT src) > 1 THEN 'conflict' ELSE min(src) END AS disposition FROM u GROUP BY sha""")
def joi23_reference_by_hash(s, d):
    parts = [T(s, d, t).select(F.sha2(F.col(c).cast("binary"), 256).alias("sha"), F.lit(t).alias("src")) for t, c in (("documents", "text"), ("benchmark", "text"), ("conversations", "text"), ("pages", "html"))]
    u = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    return u.groupBy("sha").agg(F.count(F.lit(1)).alias("refs"), F.when(F.count_distinct("src") > 1, "conflict").otherwise(F.min("src")).alias("disposition"))


@q("""SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS overlaps, 0::BIGINT AS missing, 0::BIGINT AS extra, count(*) AS total FROM orders""")
def joi24_exact_partition(s, d):
    o = T(s, d, "orders").select("o_orderkey")
    shards = [o.filter(F.pmod("o_orderkey", F.lit(3)) == i) for i in range(3)]
    union = shards[0].unionAll(shards[1]).unionAll(shards[2])
    over = union.groupBy("o_orderkey").count().filter("count > 1").agg(F.count(F.lit(1)).alias("overlaps"))
    sides = O.both_ways(o, union).agg(F.count_if(F.col("side") == "missing").alias("missing"), F.count_if(F.col("side") == "extra").alias("extra"))
    return over.crossJoin(sides).crossJoin(union.agg(F.count(F.lit(1)).alias("total")))


@q("""WITH h AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical FROM documents)
SELECT canonical, count(*) - 1 AS aliases, coalesce(string_agg(CASE WHEN doc_id <> canonical THEN doc_id::VARCHAR END, ',' ORDER BY doc_id), '') AS alias_ids FROM h GROUP BY canonical HAVING count(*) > 1""")
def joi25_alias_canonical(s, d):
    docs = T(s, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    canon = docs.groupBy("sha").agg(F.min("doc_id").alias("canonical"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    j = docs.join(canon, "sha").filter("doc_id <> canonical")
    return j.groupBy("canonical").agg(F.count(F.lit(1)).alias("aliases"), F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("alias_ids"))


@q("""WITH RECURSIVE t AS (SELECT 'R' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier),
up(node, nxt, depth, path) AS (SELECT node, parent, 0, node FROM t UNION ALL SELECT u.node, t.parent, u.depth + 1, t.node || '/' || u.path FROM up u JOIN t ON u.nxt = t.node)
SELECT node, max(depth)::INT AS depth, max_by(path, depth) AS path FROM up GROUP BY node""")
def joi26_parent_chain(s, d):
    r = T(s, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    n = T(s, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("node"), F.concat(F.lit("R"), "n_regionkey").alias("parent"))
    u = T(s, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("node"), F.concat(F.lit("N"), "s_nationkey").alias("parent"))
    return O.closure(s, r.unionAll(n).unionAll(u), "node", "parent").select("node", "depth", F.array_join("path", "/").alias("path"))


@q("""WITH e AS (SELECT DISTINCT o_custkey AS a, l_suppkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey), near AS (SELECT DISTINCT b FROM e WHERE a = 1),
fam AS (SELECT s_nationkey FROM supplier JOIN near ON s_suppkey = b) SELECT DISTINCT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM fam)""")
def joi27_one_hop_family(s, d):
    e = T(s, d, "lineitem").join(T(s, d, "orders").filter("o_custkey = 1"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    sup = T(s, d, "supplier")
    return sup.join(sup.join(e, "s_suppkey", "left_semi").select("s_nationkey").distinct(), "s_nationkey", "left_semi").select("s_suppkey")


@q("SELECT e.event_id, c.c_mktsegment AS segment FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey")
def joi28_membership_enrichment(s, d):
    return T(s, d, "events").join(T(s, d, "customer"), F.col("user_id") == F.col("c_custkey"), "left").select("event_id", F.col("c_mktsegment").alias("segment"))


@q("""WITH v(id, name, region) AS (VALUES (0, 'NATION_0', 0), (1, 'NATION_1', 1), (2, 'x', 9)) SELECT id, (n_nationkey IS NOT NULL) AS matches FROM v LEFT JOIN nation ON id = n_nationkey AND name = n_name AND region = n_regionkey""")
def joi29_values_list(s, d):
    v = s.createDataFrame([(0, "NATION_0", 0), (1, "NATION_1", 1), (2, "x", 9)], "id int, name string, region int")
    return v.join(T(s, d, "nation"), F.expr("id = n_nationkey AND name = n_name AND region = n_regionkey"), "left").select("id", F.col("n_nationkey").isNotNull().alias("matches"))


@q("""SELECT l_partkey, count(DISTINCT l_orderkey) AS docs FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_orderkey) >= 2""")
def joi30_dual_evidence(s, d):
    return T(s, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("docs")).filter("docs >= 2")


@q("""WITH a AS (SELECT o_custkey AS k, count(*) AS n, list_sort(list(DISTINCT o_orderstatus)) AS f FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1),
b AS (SELECT o_custkey AS k, count(*) AS n, list_sort(list(DISTINCT o_orderpriority)) AS f FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) + coalesce(b.n, 0) AS n, array_to_string(list_sort(list_concat(coalesce(a.f, []), coalesce(b.f, []))), ',') AS facets FROM a FULL JOIN b ON a.k = b.k""")
def joi31_merge_optional_link(s, d):
    o = T(s, d, "orders")
    a = o.filter("o_custkey % 3 <> 0").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n1"), F.collect_set("o_orderstatus").alias("f1"))
    b = o.filter("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n2"), F.collect_set("o_orderpriority").alias("f2"))
    none = F.array().cast("array<string>")
    return a.join(b, "k", "full_outer").select("k", (F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"), F.array_join(F.array_sort(F.array_union(F.coalesce("f1", none), F.coalesce("f2", none))), ",").alias("facets"))


@q("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'primary' ELSE 'fallback' END AS origin, o_orderstatus AS value FROM orders""")
def joi32_fill_gaps(s, d):
    o = T(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("value"))
    return O.fill(o.filter("o_orderkey % 3 = 0"), o, "o_orderkey", "value", ("primary", "fallback"))


@q("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'third' WHEN o_orderkey % 2 = 0 THEN 'second' ELSE 'first' END AS status FROM orders""")
def joi33_overlay(s, d):
    o = T(s, d, "orders").select("o_orderkey")
    return O.overlay([o.withColumn("status", F.lit("first")), o.filter("o_orderkey % 2 = 0").withColumn("status", F.lit("second")), o.filter("o_orderkey % 4 = 0").withColumn("status", F.lit("third"))], "o_orderkey")


# --- sorts and sets ------------------------------------------------------------------------------


@q("SELECT doc_id, coalesce(quality, 0)::INT AS quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY coalesce(quality, 0) DESC, doc_id")
def srt01_coalesced_sort(s, d):
    j = T(s, d, "documents").select("doc_id").join(T(s, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality")).orderBy(F.desc("quality"), "doc_id")


@q("SELECT doc_id, lang FROM documents ORDER BY CASE lang WHEN 'fr' THEN 1 WHEN 'es' THEN 2 ELSE 99 END, doc_id")
def srt02_custom_order(s, d):
    rank = F.array_position(F.array(F.lit("fr"), F.lit("es")), F.col("lang"))
    return T(s, d, "documents").select("doc_id", "lang").orderBy(F.when(rank > 0, rank).otherwise(F.lit(99)), "doc_id")


@q("SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'steel') ORDER BY (lower(p_type) = 'steel') DESC, p_type, p_size, p_partkey LIMIT 60")
def srt03_exact_first(s, d):
    return T(s, d, "part").filter(F.contains(F.lower("p_type"), F.lit("steel"))).orderBy((F.lower("p_type") == "steel").desc(), "p_type", "p_size", "p_partkey").limit(60).select("p_partkey", "p_type")


@q("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def srt04_paging(s, d):
    page, size = max(0, 2), min(max(1, 25), 100)
    return T(s, d, "orders").select("o_orderkey").orderBy("o_orderkey").offset(page * size).limit(size)


@q("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 160")
def srt05_top_k(s, d):
    return T(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(160)


@q("""SELECT vec_id, row_number() OVER (ORDER BY floor(embedding[1]::DOUBLE / 0.012), embedding[2]::DOUBLE, vec_id) AS reading FROM embeddings""")
def srt06_reading_order(s, d):
    """Bands of y first, then x: a total order, where comparing by 'close enough' is not transitive. Ranked over a range-partitioned sort."""
    e = T(s, d, "embeddings").select("vec_id", F.floor(F.col("embedding")[0].cast("double") / 0.012).alias("band"), F.col("embedding")[1].cast("double").alias("x"))
    return O.ordinals(e, ["band", "x", "vec_id"], "reading").select("vec_id", "reading")


@q("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS priority FROM orders ORDER BY priority, o_custkey, o_orderkey""")
def srt07_priority_queue(s, d):
    p = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(3)
    return T(s, d, "orders").select("o_orderkey", p.alias("priority"), "o_custkey").orderBy("priority", "o_custkey", "o_orderkey").drop("o_custkey")


@q()
def srt08_locale_sort(s, d):
    """Names in a locale's order, binary order as the tie-break."""
    return T(s, d, "nation").select("n_name").orderBy(F.expr("n_name COLLATE UNICODE"), "n_name")


@q("""SELECT 'customer' AS layer, c_custkey AS id, c_acctbal AS value FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier""")
def set01_union_layers(s, d):
    a = T(s, d, "customer").select(F.lit("customer").alias("layer"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    b = T(s, d, "supplier").select(F.lit("supplier").alias("layer"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("value"))
    return a.unionByName(b, allowMissingColumns=True)


@q("""SELECT id, layer FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS n FROM (SELECT c_custkey AS id, 'customer' AS layer, 1 AS p FROM customer UNION ALL SELECT s_suppkey, 'supplier', 2 FROM supplier)) WHERE n = 1""")
def set02_first_wins(s, d):
    a = T(s, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("layer"), F.lit(1).alias("p"))
    b = T(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("layer"), F.lit(2).alias("p"))
    return O.first_per_key(a.unionAll(b), "id", "p").select("id", "layer")


@q("""SELECT id, layer FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC) AS n FROM (SELECT c_custkey AS id, 'customer' AS layer, 1 AS p FROM customer UNION ALL SELECT s_suppkey, 'supplier', 2 FROM supplier)) WHERE n = 1""")
def set03_last_wins(s, d):
    a = T(s, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("layer"))
    b = T(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("layer"))
    return O.overlay([a, b], "id")


@q("""SELECT source, min(doc_id) AS doc_id FROM documents WHERE source IS NOT NULL AND source <> '' GROUP BY source""")
def set04_distinct_by_key(s, d):
    docs = T(s, d, "documents").select("doc_id", "source").filter("source IS NOT NULL AND source <> ''")
    return O.first_per_key(docs, "source", "doc_id")


@q("""SELECT 'missing' AS side, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'extra', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def set05_difference_both_ways(s, d):
    return O.both_ways(T(s, d, "documents").select("doc_id"), T(s, d, "labels").select("doc_id"))


@q("""WITH f AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS p FROM orders GROUP BY 1) SELECT o_custkey FROM f WHERE list_has_any(p, ['1-URGENT', '2-HIGH'])""")
def set06_intersection_test(s, d):
    f = T(s, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    return f.filter(F.arrays_overlap("p", F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))).select("o_custkey")


@q("""SELECT count(*) AS total, count(*) FILTER (WHERE n_chars < 500) + count(*) FILTER (WHERE n_chars BETWEEN 500 AND 4999) + count(*) FILTER (WHERE n_chars >= 5000) AS parts, true AS sound FROM documents""")
def set07_exhaustive_partition(s, d):
    n = F.col("n_chars")
    parts = F.count_if(n < 500) + F.count_if(n.between(500, 4999)) + F.count_if(n >= 5000)
    return T(s, d, "documents").agg(F.count(F.lit(1)).alias("total"), parts.alias("parts"), (F.count(F.lit(1)) == parts).alias("sound"))


@q("""SELECT sha256(text) AS sha, count(*) AS rows, count(DISTINCT lang || '|' || source) AS variants, count(DISTINCT lang || '|' || source) > 1 AS conflict FROM documents GROUP BY 1 HAVING count(*) > 1""")
def set08_equivalence_or_conflict(s, d):
    docs = T(s, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha"), X.stable_json("lang", "source").alias("j"))
    return docs.groupBy("sha").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("j").alias("variants"), (F.count_distinct("j") > 1).alias("conflict")).filter("rows > 1")


@q("""WITH m AS (SELECT unnest(range(0, (SELECT max(doc_id) + 1 FROM documents))) AS id), g AS (SELECT id FROM m WHERE id NOT IN (SELECT doc_id FROM labels)),
i AS (SELECT id, id - row_number() OVER (ORDER BY id) AS k FROM g) SELECT min(id) AS first, max(id) AS last, count(*) AS length FROM i GROUP BY k""")
def set09_complement_islands(s, d):
    """Numbers are made by ranges; runs that a range's edge cuts are told by the row before, so a window holds one range, not all ids."""
    top = T(s, d, "documents").agg(F.max("doc_id").alias("m")).first()["m"]
    every = s.range(0, (-1 if top is None else top) + 1)
    rest = every.join(T(s, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti")
    place = O.ordinals(rest, ["id"], "place")  # an island has one difference of id and place
    return place.groupBy((F.col("id") - F.col("place")).alias("k")).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("length")).drop("k")


@q("""SELECT 0::BIGINT AS in_both, count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, 0::BIGINT AS unexpected FROM documents d LEFT JOIN labels l USING (doc_id)""")
def set10_disjoint_cover(s, d):
    every, lab = T(s, d, "documents").select("doc_id"), T(s, d, "labels")
    queued, blocked = lab.filter("toxic = 0").select("doc_id"), lab.filter("toxic = 1").select("doc_id")
    cover = queued.unionAll(blocked)
    n = F.count(F.lit(1))
    return queued.intersect(blocked).agg(n.alias("in_both")).crossJoin(every.join(cover, "doc_id", "left_anti").agg(n.alias("missing"))).crossJoin(cover.join(every, "doc_id", "left_anti").agg(n.alias("unexpected")))
