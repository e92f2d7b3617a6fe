"""Aggregates and window operators. Query names begin with the operators' ids."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight import functions as X
from quarrylight import operators as O
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


@q("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def agg01_filtered_count(s, d):
    return T(s, d, "orders").filter("o_orderstatus = 'F'").agg(n().alias("n"))


@q("SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS closed_customers FROM orders")
def agg02_distinct_counts(s, d):
    return T(s, d, "orders").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey"))).alias("closed_customers"))


@q("SELECT coalesce(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0)::BIGINT AS toxic, count(*) FILTER (WHERE quality = 1) AS good, coalesce(sum(CASE WHEN quality > 5 THEN 1 END), 0)::BIGINT AS none FROM labels")
def agg03_conditional_sum(s, d):
    return T(s, d, "labels").agg(F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0)).alias("toxic"), F.count_if(F.col("quality") == 1).alias("good"), F.coalesce(F.sum(F.when(F.col("quality") > 5, 1)), F.lit(0)).cast("long").alias("none"))


@q("SELECT lang, source, count(*) AS n, min(n_chars) AS lo, max(n_chars) AS hi FROM documents GROUP BY lang, source")
def agg04_group_by(s, d):
    return T(s, d, "documents").groupBy("lang", "source").agg(n().alias("n"), F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))


@q("SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def agg04x_rollup(s, d):
    """An extra of the engine: subtotals."""
    return T(s, d, "documents").rollup("lang", "source").agg(n().alias("n")).select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n")


@q("SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg04x_cube(s, d):
    """An extra of the engine: all subtotals."""
    return T(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(n().alias("n")).select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n")


@q("SELECT o_orderkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1 GROUP BY o_orderkey HAVING count(l_orderkey) = 0")
def agg05_having_zero(s, d):
    first = T(s, d, "lineitem").filter("l_linenumber = 1")
    return T(s, d, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey").distinct()


@q("""SELECT '{"documents":' || (SELECT count(*) FROM documents) || ',"labels":' || (SELECT count(*) FROM labels) || ',"events":' || (SELECT count(*) FROM events) || '}' AS counts""")
def agg06_json_counts(s, d):
    one = None
    for t in ("documents", "labels", "events"):
        a = T(s, d, t).agg(n().alias(t))
        one = a if one is None else one.crossJoin(a)
    return one.select(F.to_json(F.struct("documents", "labels", "events")).alias("counts"))


@q("SELECT 'orders' AS name, count(*) AS live, true AS equal FROM orders UNION ALL SELECT 'nation', count(*), count(*) = 25 FROM nation")
def agg07_expected_actual(s, d):
    live = T(s, d, "orders").agg(n().alias("live")).withColumn("name", F.lit("orders")).unionByName(T(s, d, "nation").agg(n().alias("live")).withColumn("name", F.lit("nation")))
    expected = s.createDataFrame([("nation", 25)], "name string, expected long")
    return live.join(expected, "name", "left").select("name", "live", (F.col("live") == F.coalesce("expected", "live")).alias("equal"))


@q("WITH k(event_type) AS (VALUES ('click'), ('view'), ('purchase'), ('never')) SELECT k.event_type, count(e.event_id) AS n FROM k LEFT JOIN events e USING (event_type) GROUP BY 1")
def agg08_histogram(s, d):
    return O.histogram(T(s, d, "events"), F.col("event_type"), "event_type", ["click", "view", "purchase", "never"])


@q("SELECT count(*) AS documents, count(*) FILTER (WHERE lang = 'en') AS english, count(*) FILTER (WHERE n_chars > 5000) AS long FROM documents")
def agg09_filtered_counts(s, d):
    return T(s, d, "documents").agg(n().alias("documents"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("n_chars") > 5000).alias("long"))


@q("SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def agg10_arg_max(s, d):
    return O.first_per_key(T(s, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", F.desc("c_acctbal"), "c_custkey")


@q("SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'P' THEN 2 ELSE 1 END) WHEN 3 THEN 'F' WHEN 2 THEN 'P' ELSE 'O' END AS best FROM orders GROUP BY o_custkey")
def agg11_best_by_rank(s, d):
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 2).otherwise(1)
    return T(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", rank).alias("best"))


@q("SELECT user_id, event_type, ts::DATE AS day, count(*) AS n, round(sum(value), 2) AS total, count(DISTINCT hour(ts)) AS hours FROM events GROUP BY 1, 2, 3")
def agg12_accumulating_groups(s, d):
    return T(s, d, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(n().alias("n"), F.round(F.sum("value"), 2).alias("total"), F.size(F.collect_set(F.hour("ts"))).cast("long").alias("hours"))


@q("SELECT l_orderkey, l_partkey FROM lineitem l JOIN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1) USING (l_orderkey)")
def agg13_singleton_groups(s, d):
    w = Window.partitionBy("l_orderkey")
    return T(s, d, "lineitem").select("l_orderkey", "l_partkey", F.count(F.lit(1)).over(w).alias("c")).filter("c = 1").drop("c")


@q("SELECT lang, round(count(*) FILTER (WHERE contains(text, 'tion')) / count(*) * 10000, 4) AS core, CASE WHEN count(*) FILTER (WHERE n_chars > 1e9) > 0 THEN 1.0 END AS none FROM documents GROUP BY lang")
def agg14_guarded_rate(s, d):
    g = T(s, d, "documents").groupBy("lang").agg(F.count_if(F.col("text").contains("tion")).alias("k"), n().alias("m"), F.count_if(F.col("n_chars") > 1e9).alias("z"))
    return g.select("lang", O.rate(F.col("k"), F.col("m")).alias("core"), O.rate(F.col("k"), F.col("z")).alias("none"))


@q("SELECT p_partkey, round(0.28 + 0.72 * sqrt(p_size / max(p_size) OVER (PARTITION BY p_brand)), 4) AS strength FROM part")
def agg15_max_normalisation(s, d):
    top = F.max("p_size").over(Window.partitionBy("p_brand"))
    return T(s, d, "part").select("p_partkey", X.root_strength(F.col("p_size"), top).alias("strength"))


@q("""WITH l AS (SELECT DISTINCT doc_id, sha256(line) AS sha FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) >= 24)
SELECT sha, count(*) AS docs FROM l GROUP BY sha HAVING count(*) >= 3""")
def agg16_reuse_clusters(s, d):
    lines = T(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).filter(F.length("line") >= 24)
    return lines.groupBy(F.sha2(F.col("line").cast("binary"), 256).alias("sha")).agg(F.count_distinct("doc_id").alias("docs")).filter("docs >= 3")


@q("""WITH k AS (SELECT text, count(*) AS m FROM documents GROUP BY text) SELECT coalesce(sum(CASE WHEN lang = 'en' AND m = 1 THEN n_chars END), 0)::BIGINT AS native, coalesce(sum(CASE WHEN lang <> 'en' AND m = 1 THEN n_chars END), 0)::BIGINT AS other FROM documents JOIN k USING (text)""")
def agg17_denominators(s, d):
    docs = T(s, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "lang", "n_chars")
    once = docs.groupBy("sha").agg(n().alias("m"), F.min("lang").alias("lang"), F.min("n_chars").alias("c")).filter("m = 1")
    return once.agg(F.coalesce(F.sum(F.when(F.col("lang") == "en", F.col("c"))), F.lit(0)).alias("native"), F.coalesce(F.sum(F.when(F.col("lang") != "en", F.col("c"))), F.lit(0)).alias("other"))


@q("SELECT source, count(*) AS expected, count(l.doc_id) AS usable, count(l.doc_id) >= ceil(0.95 * count(*)) AS complete FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def agg18_coverage(s, d):
    j = T(s, d, "documents").select("doc_id", "source").join(T(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    g = j.groupBy("source").agg(n().alias("expected"), F.count("quality").alias("usable"))
    return g.select("*", (F.col("usable") >= F.ceil(0.95 * F.col("expected"))).alias("complete"))


@q("""SELECT sha256(text) AS sha, min_by(doc_id, struct_pack(a := (source <> 'src0')::INT, b := doc_id)) AS canonical, max(n_chars) AS completed, count(*) AS members FROM documents GROUP BY 1 HAVING count(*) > 1""")
def agg19_canonical_pick(s, d):
    g = T(s, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return g.agg(F.min_by("doc_id", F.struct((F.col("source") != "src0").cast("int"), F.col("doc_id"))).alias("canonical"), F.max("n_chars").alias("completed"), n().alias("members")).filter("members > 1")


@q("""WITH f AS (SELECT l_orderkey, l_linenumber, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
p AS (SELECT l_orderkey, count(*) AS covered FROM f WHERE k = 0 GROUP BY 1), t AS (SELECT l_orderkey, max(l_linenumber) AS total FROM lineitem GROUP BY 1)
SELECT l_orderkey, coalesce(covered, 0) AS covered, total - coalesce(covered, 0) AS remaining FROM t LEFT JOIN p USING (l_orderkey)""")
def agg20_prefix_coverage(s, d):
    li = T(s, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    prefix = O.islands(li, "l_orderkey", "l_linenumber").filter("first = 1").select("l_orderkey", F.col("length").alias("covered"))
    total = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("total"))
    c = F.coalesce("covered", F.lit(0))
    return total.join(prefix, "l_orderkey", "left").select("l_orderkey", c.alias("covered"), (F.col("total") - c).alias("remaining"))


@q("SELECT event_type, coalesce(round(avg(CASE WHEN isfinite(value) THEN value END), 6), 0) AS mean FROM events GROUP BY 1")
def agg21_rounded_mean(s, d):
    v = F.nullif(F.col("value"), F.lit(float("nan")))
    return T(s, d, "events").groupBy("event_type").agg(F.coalesce(F.round(F.avg(v), 6), F.lit(0.0)).alias("mean"))


@q("SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def agg22_p95(s, d):
    return T(s, d, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


@q("""SELECT CASE WHEN lang IN ('fr', 'es') THEN 'romance' WHEN lang IN ('de', 'en') THEN 'germanic' ELSE lang END AS facet, sum(n)::BIGINT AS n, min(lo) AS first, max(hi) AS last
FROM (SELECT lang, count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi FROM documents GROUP BY lang) GROUP BY 1""")
def agg23_merged_keys(s, d):
    base = T(s, d, "documents").groupBy("lang").agg(n().alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    facet = F.when(F.col("lang").isin("fr", "es"), "romance").when(F.col("lang").isin("de", "en"), "germanic").otherwise(F.col("lang"))
    return base.groupBy(facet.alias("facet")).agg(F.sum("n").alias("n"), F.min("lo").alias("first"), F.max("hi").alias("last"))


@q("SELECT source, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'es') AS es, count(*) FILTER (WHERE lang = 'fr') AS fr FROM documents GROUP BY source")
def agg24_cross_tab(s, d):
    return T(s, d, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().fillna(0)


@q("WITH f(facet) AS (VALUES ('en'), ('fr'), ('it')) SELECT facet, count(doc_id) AS n FROM f LEFT JOIN documents ON lang = facet GROUP BY facet")
def agg25_facet_counts(s, d):
    return O.histogram(T(s, d, "documents"), F.col("lang"), "facet", ["en", "fr", "it"])


@q("SELECT o_custkey, bool_or(o_orderstatus = 'F') AS any_closed, bool_and(o_totalprice > 1000) AS all_large FROM orders GROUP BY 1")
def agg26_any_all(s, d):
    return T(s, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("any_closed"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_large"))


@q("SELECT label, min(embedding[1]) AS min_x, max(embedding[1]) AS max_x, min(embedding[2]) AS min_y, max(embedding[2]) AS max_y FROM embeddings GROUP BY label")
def agg27_bounding_box(s, d):
    return T(s, d, "embeddings").select("label", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y")).groupBy("label").agg(*O.bounds("x", "y"))


@q("""SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, max_by(event_type, struct_pack(t := ts, e := event_id)) AS last_type, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM events GROUP BY 1""")
def agg28_task_rollup(s, d):
    return T(s, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


@q("SELECT l_orderkey, sha256(string_agg(l_linenumber || ':' || l_partkey, chr(10) ORDER BY l_linenumber, l_linenumber || ':' || l_partkey)) AS digest FROM lineitem GROUP BY 1")
def agg29_ordered_digest(s, d):
    line = F.concat_ws(":", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    return T(s, d, "lineitem").groupBy("l_orderkey").agg(O.digest(F.col("l_linenumber"), line).alias("digest"))


@q("SELECT o_custkey, sum(q)::DOUBLE AS total, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS parts FROM (SELECT l_orderkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def agg30_merge_lists(s, d):
    per = T(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.collect_set("l_partkey").alias("p"))
    j = per.join(T(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_custkey").agg(F.sum("q").alias("total"), F.array_join(F.transform(F.array_sort(F.array_distinct(F.flatten(F.collect_list("p")))), lambda x: x.cast("string")), ",").alias("parts"))


@q("SELECT count(DISTINCT y) AS years, min(y) AS first, max(y) AS last FROM (SELECT year(o_orderdate) AS y FROM orders) WHERE y >= 1800")
def agg31_distinct_years(s, d):
    return T(s, d, "orders").select(F.year("o_orderdate").alias("y")).filter("y >= 1800").agg(F.count_distinct("y").alias("years"), F.min("y").alias("first"), F.max("y").alias("last"))


@q("""WITH f AS (SELECT source, split_part(text, ' ', 1) AS w FROM documents), c AS (SELECT source, w, count(*) AS n FROM f GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT source, string_agg(w || ':' || n, ',' ORDER BY n DESC, w) AS variants FROM c GROUP BY source""")
def agg32_variants(s, d):
    c = T(s, d, "documents").groupBy("source", F.split_part("text", F.lit(" "), F.lit(1)).alias("w")).agg(n().alias("n")).filter("n >= 2")
    g = c.groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "w", "n"))).alias("v"))
    return g.select("source", F.array_join(F.transform("v", lambda x: F.concat_ws(":", x["w"], x["n"].cast("string"))), ",").alias("variants"))


@q("""WITH a(anchor) AS (VALUES ('tion'), ('the'), ('zzz')) SELECT lang, round(avg(CASE WHEN contains(text, anchor) THEN 1.0 ELSE 0.0 END), 4) AS recall FROM documents, a GROUP BY lang""")
def agg33_anchor_recall(s, d):
    anchors = F.array(F.lit("tion"), F.lit("the"), F.lit("zzz"))
    e = T(s, d, "documents").select("lang", "text", F.explode(anchors).alias("anchor"))
    return e.groupBy("lang").agg(F.round(F.avg(F.contains("text", "anchor").cast("double")), 4).alias("recall"))


@q("SELECT r_name, count(*) AS nations, sum(n)::BIGINT AS customers, min(n) AS least, max(n) AS most FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def agg34_two_level(s, d):
    per = T(s, d, "customer").groupBy("c_nationkey").agg(n().alias("n"))
    j = per.join(T(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(T(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(n().alias("nations"), F.sum("n").alias("customers"), F.min("n").alias("least"), F.max("n").alias("most"))


@q("""SELECT 'documents' AS asset, count(*) AS rows, count(DISTINCT doc_id) AS ids FROM documents UNION ALL SELECT 'pages', count(*), count(DISTINCT page_id) FROM pages UNION ALL SELECT 'conversations', count(*), count(DISTINCT conv_id) FROM conversations""")
def agg35_asset_counters(s, d):
    out = None
    for t, k in (("documents", "doc_id"), ("pages", "page_id"), ("conversations", "conv_id")):
        a = T(s, d, t).agg(n().alias("rows"), F.count_distinct(k).alias("ids")).select(F.lit(t).alias("asset"), "rows", "ids")
        out = a if out is None else out.unionAll(a)
    return out


@q("SELECT (SELECT count(*) FROM lineitem) AS observed, (SELECT sum(c) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey))::BIGINT AS expected, true AS conserved")
def agg36_conservation(s, d):
    li = T(s, d, "lineitem")
    j = li.agg(n().alias("observed")).crossJoin(li.groupBy("l_orderkey").agg(n().alias("c")).agg(F.sum("c").alias("expected")))
    return j.select("*", (F.col("observed") == F.col("expected")).alias("conserved"))


# --- windows -------------------------------------------------------------------------------------


@q("SELECT o_custkey, source, target FROM (SELECT o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS source, o_orderkey AS target FROM orders) WHERE source IS NOT NULL")
def win01_consecutive_edges(s, d):
    return O.consecutive(T(s, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")


@q("""WITH y AS (SELECT c_nationkey AS nat, year(o_orderdate) AS y, min(o_orderkey) AS k, count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
x AS (SELECT y, k, lag(k) OVER (PARTITION BY y ORDER BY nat) AS p FROM y WHERE c <= 30) SELECT y, p AS source, k AS target FROM x WHERE p IS NOT NULL""")
def win02_chain_across(s, d):
    j = T(s, d, "orders").join(T(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    y = j.groupBy(F.col("c_nationkey").alias("nat"), F.year("o_orderdate").alias("y")).agg(F.min("o_orderkey").alias("k"), n().alias("c")).filter("c <= 30")
    return O.consecutive(y, "y", ["nat"], "k")


@q("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, i AS block, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ordinal FROM l WHERE length(line) >= 24""")
def win03_running_ordinal(s, d):
    """Blocks are numbered within the row, where they lie in order already: nothing is shuffled."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("line"), (i + 1).cast("long").alias("block")))
    kept = F.filter(numbered, lambda x: F.length(x["line"]) >= 24)
    lines = T(s, d, "documents").select("doc_id", F.posexplode(kept).alias("p", "x"))
    return lines.select("doc_id", "x.block", (F.col("p") + 1).cast("long").alias("ordinal"))


@q("SELECT o_custkey, o_orderkey, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1, 999999) AS range_end FROM orders")
def win04_lead_ranges(s, d):
    return O.lead_ranges(T(s, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", F.lit(999999).cast("long"))


@q("""WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem), y AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS k FROM x)
SELECT l_orderkey, l_returnflag, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS length FROM y GROUP BY l_orderkey, l_returnflag, k HAVING count(*) >= 2""")
def win05_islands(s, d):
    x = T(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    return O.islands(x, "l_orderkey", "l_linenumber", "l_returnflag").filter("length >= 2")


@q("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_user_turn FROM conversations""")
def win06_carry_forward(s, d):
    c = T(s, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("u"))
    return O.carry_forward(c, "conv_id", ["turn"], "u", "last_user_turn").drop("u")


@q("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1 OR event_type IS DISTINCT FROM p""")
def win07_adjacent_duplicates(s, d):
    e = T(s, d, "events").select("event_id", "user_id", "event_type", "ts")
    return O.drop_adjacent(e, "user_id", ["ts", "event_id"], "event_type").drop("ts")


@q("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS purchase_id FROM events""")
def win08_attach_previous(s, d):
    e = T(s, d, "events").withColumn("g", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return O.carry_forward(e, "user_id", ["ts", "event_id"], "g", "purchase_id").select("event_id", "purchase_id")


@q("SELECT c_mktsegment, c_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 6")
def win09_top_k(s, d):
    return O.top_k(T(s, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal"), "c_mktsegment", 6, F.desc("c_acctbal"), "c_custkey").drop("c_acctbal")


@q("SELECT p_partkey, max(p_retailprice) OVER (PARTITION BY p_brand) AS top FROM part")
def win10_partition_max(s, d):
    return T(s, d, "part").select("p_partkey", F.max("p_retailprice").over(Window.partitionBy("p_brand")).alias("top"))


@q("SELECT o_orderkey FROM (SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS c FROM orders) WHERE c = 1")
def win11_unique_in_partition(s, d):
    w = Window.partitionBy("o_custkey", F.year("o_orderdate"))
    return T(s, d, "orders").select("o_orderkey", n().over(w).alias("c")).filter("c = 1").drop("c")


@q("SELECT p_brand, p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY (p_partkey <= 100), p_partkey) - 1) AS turn FROM part WHERE p_size = 10")
def win12_round_robin(s, d):
    """Next after the last served id, then around again."""
    w = Window.partitionBy("p_brand").orderBy(F.col("p_partkey") <= 100, "p_partkey")
    return T(s, d, "part").filter("p_size = 10").select("p_brand", "p_partkey", (F.row_number().over(w) - 1).cast("long").alias("turn"))


@q("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 119 PRECEDING AND CURRENT ROW), 2) AS total FROM events")
def win13_ring(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-119, 0)
    return T(s, d, "events").select("event_id", F.round(F.sum("value").over(w), 2).alias("total"))


@q("""WITH f AS (SELECT user_id, event_id, ts, (value < 20) AS stale, sum((value >= 20)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
SELECT event_id, CASE WHEN stale THEN row_number() OVER (PARTITION BY user_id, g, stale ORDER BY ts, event_id) ELSE 0 END AS confirmations FROM f""")
def win14_stale_confirmations(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = T(s, d, "events").select("user_id", "event_id", "ts", (F.col("value") < 20).alias("stale")).withColumn("g", F.sum((~F.col("stale")).cast("int")).over(w))
    k = F.row_number().over(Window.partitionBy("user_id", "g", "stale").orderBy("ts", "event_id"))
    return f.select("event_id", F.when(F.col("stale"), k).otherwise(F.lit(0)).cast("long").alias("confirmations"))


@q()
def win15_label_placement(s, d):
    """In each label's cell, boxes in order of priority; those that overlap an accepted one are skipped."""
    e = T(s, d, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("x"))
    g = e.groupBy("label").agg(F.array_sort(F.collect_list(F.struct(F.abs("x").alias("p"), F.col("vec_id").alias("id"), F.col("x").alias("start"), (F.col("x") + 0.05).alias("end")))).alias("boxes"))
    return g.select("label", F.size(O.greedy_overlap(F.col("boxes"))).alias("placed"), F.size("boxes").alias("boxes"))


@q("""SELECT o_custkey, o_orderkey FROM (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) WHERE p + 1 <> o_orderkey""")
def win16_contiguity(s, d):
    o = T(s, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("e"))
    return O.breaks(o, "o_custkey", "o_orderkey", "e").select("o_custkey", "o_orderkey")


@q("""SELECT o_custkey, o_orderkey FROM (SELECT *, lag(o_orderkey + 500) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) WHERE p >= o_orderkey""")
def win17_non_overlap(s, d):
    o = T(s, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") + 500).alias("e"))
    return O.breaks(o, "o_custkey", "o_orderkey", "e", contiguous=False).select("o_custkey", "o_orderkey")
