"""Streams, graphs, sinks and releases over the tables. Query names begin with the operators' ids."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from quarrylight import functions as X
from quarrylight import operators as O
from quarrylight import streaming as R
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


def events(s, d):
    return T(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def through_stream(s, d, build, mode: str):
    """Run a streaming query over the events file to its end, into a table in memory."""
    path = f"{d}/events.parquet"
    stream = R.event_stream(s, path, s.read.parquet(path).schema)
    name = f"out_{uuid.uuid4().hex}"
    run = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return s.table(name)


def latest_of_stream(s, stream, key: str):
    """Run a streaming query in update mode to its end; the rows of each batch are written under its number, of each key the last one counts."""
    path = shared_folder(s)
    run = stream.writeStream.outputMode("update").option("checkpointLocation", shared_folder(s)).trigger(availableNow=True)
    run.foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}")).start().awaitTermination()
    return O.first_per_key(s.read.schema(StructType([*stream.schema, StructField("batch", LongType())])).parquet(path), key, F.desc("batch")).drop("batch")


# --- streams -------------------------------------------------------------------------------------


@q("SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def str01_window_counts(s, d):
    return R.window_counts(events(s, d), ["event_type"], 3600)


@q("SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def str01_window_counts_stream(s, d):
    return through_stream(s, d, lambda e: R.window_counts(e, ["event_type"], 3600, "1 hour"), "complete")


@q("SELECT event_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 3600) ORDER BY ts, event_id) <= 1 AS accepted FROM events")
def str01_rate_verdicts(s, d):
    return R.rate_verdicts(T(s, d, "events"), ["user_id"], ["ts", "event_id"], 1, 3600).select("event_id", "accepted")


@q("SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start, count(*) AS n FROM (SELECT ts FROM events UNION ALL SELECT ts - INTERVAL 30 MINUTE FROM events) GROUP BY 1")
def str01x_sliding(s, d):
    """An extra: windows of an hour every half hour."""
    return R.sliding_counts(events(s, d), [], "1 hour", "30 minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@q("""WITH g AS (SELECT *, (lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE)::INT AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, k.k""")
def str01x_sessions(s, d):
    """An extra: sessions that half an hour without events ends."""
    return R.sessions(events(s, d), ["user_id"], "30 minutes").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


_OUT = "o AS (SELECT user_id::VARCHAR AS key, ts, value >= 30 AS ok FROM events)"


@q(f"""WITH {_OUT}, l AS (SELECT *, max(CASE WHEN ok THEN ts END) OVER (PARTITION BY key) AS last_ok FROM o),
f AS (SELECT key, ts, row_number() OVER (PARTITION BY key ORDER BY ts) AS r FROM l WHERE NOT ok AND (last_ok IS NULL OR ts > last_ok)),
a AS (SELECT key, least(count(*), 5)::INT AS attempts FROM f GROUP BY key) SELECT k.key, coalesce(attempts, 0) AS attempts, coalesce(attempts, 0) >= 5 AS quarantined FROM (SELECT DISTINCT key FROM o) k LEFT JOIN a USING (key)""")
def str02_retry_ledger(s, d):
    o = events(s, d).select(F.col("user_id").cast("string").alias("key"), "ts", (F.col("value") >= 30).alias("ok"))
    return R.retry_ledger(o).select("key", "attempts", "quarantined")


@q(ORACLE["str02_retry_ledger"])
def str02_retry_stream(s, d):
    ship(s)
    path = f"{d}/events.parquet"
    e = R.event_stream(s, path, s.read.parquet(path).schema)
    states = R.retry_states(e.select(F.col("user_id").cast("string").alias("key"), "ts", (F.col("value") >= 30).alias("ok")))
    return latest_of_stream(s, states, "key").select("key", "attempts", "quarantined")


@q("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 20")
def str03_pending(s, d):
    lab = T(s, d, "labels")
    return R.pending(T(s, d, "documents").select("doc_id"), lab.filter("toxic = 0").select("doc_id"), lab.filter("toxic = 1").select("doc_id"), ["doc_id"], 20)


@q("SELECT p_partkey, CASE WHEN p_size < 5 THEN 1 WHEN p_size < 10 THEN 2 ELSE 3 END AS lane FROM part WHERE p_size < 20")
def str04_scheduler(s, d):
    lane = F.when(F.col("p_size") < 5, 1).when(F.col("p_size") < 10, 2).otherwise(3)
    return T(s, d, "part").filter("p_size < 20").select("p_partkey", lane.alias("lane"), "p_brand").orderBy("lane", "p_brand", "p_partkey").drop("p_brand")


@q("""WITH x AS (SELECT source, count(*) FILTER (WHERE toxic = 1) AS failed, count(*) FILTER (WHERE quality IS NULL) AS pending, max(n_chars) AS age FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, CASE WHEN failed > 0 THEN 'halt' WHEN pending = 0 THEN 'done' WHEN age > 600 THEN 'restart' ELSE 'continue' END AS action, CASE WHEN failed > 0 THEN 2 WHEN pending = 0 THEN 0 WHEN age > 600 THEN 1 ELSE 0 END AS exit_code FROM x""")
def str05_health(s, d):
    j = T(s, d, "documents").select("doc_id", "source", "n_chars").join(T(s, d, "labels"), "doc_id", "left")
    g = j.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("failed"), F.count_if(F.col("quality").isNull()).alias("pending"), F.max("n_chars").alias("age"))
    return R.health(g).select("source", "action", "exit_code")


@q("SELECT user_id, count(*) FILTER (WHERE value >= 30) AS completed, count(*) FILTER (WHERE value < 30) AS failed, (epoch(TIMESTAMP '2024-02-01') - epoch(max(date_trunc('second', ts))))::BIGINT AS age FROM events GROUP BY 1")
def str06_progress(s, d):
    e = events(s, d)
    age = F.unix_timestamp(F.lit("2024-02-01 00:00:00").cast("timestamp")) - F.unix_timestamp(F.max("ts"))
    return e.groupBy("user_id").agg(F.count_if(F.col("value") >= 30).alias("completed"), F.count_if(F.col("value") < 30).alias("failed"), age.alias("age"))


@q("""WITH r(code, rank, severity) AS (VALUES ('click', 1, 'warning'), ('purchase', 3, 'blocked'), ('view', 0, 'ok')), c AS (SELECT DISTINCT user_id, event_type AS code FROM events WHERE value > 60)
SELECT user_id, CASE max(coalesce(rank, 0)) WHEN 3 THEN 'blocked' WHEN 1 THEN 'warning' ELSE 'ok' END AS severity, string_agg(c.code, ',' ORDER BY c.code) AS codes FROM c LEFT JOIN r USING (code) GROUP BY 1""")
def str07_severity(s, d):
    rules = s.createDataFrame([("click", "warning"), ("purchase", "blocked"), ("view", "ok")], "code string, severity string")
    return R.severity(T(s, d, "events").filter("value > 60").select("user_id", F.col("event_type").alias("code")), rules, "user_id")


@q("""WITH f AS (SELECT user_id, ts, event_id, value < 20 AS stale, sum((value >= 20)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
c AS (SELECT user_id, event_id, CASE WHEN stale THEN row_number() OVER (PARTITION BY user_id, g, stale ORDER BY ts, event_id) END AS k FROM f) SELECT user_id, count(*) AS actions FROM c WHERE k = 2 GROUP BY 1""")
def str08_confirmed_stalls(s, d):
    """Acts once, at the second stale observation on end."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = T(s, d, "events").select("user_id", "event_id", "ts", (F.col("value") < 20).alias("stale")).withColumn("g", F.sum((~F.col("stale")).cast("int")).over(w))
    c = f.filter("stale").withColumn("k", F.row_number().over(Window.partitionBy("user_id", "g").orderBy("ts", "event_id")))
    return c.filter("k = 2").groupBy("user_id").agg(n().alias("actions"))


@q("""WITH x AS (SELECT user_id, event_id, ts, event_type AS codes, value >= 30 AS ok, coalesce(lag(value >= 30) OVER (PARTITION BY user_id ORDER BY ts, event_id), true) AS b FROM events),
e AS (SELECT *, sum((ok AND NOT b)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, codes, epoch ORDER BY ts, event_id) AS k FROM e WHERE NOT ok) SELECT event_id, epoch::BIGINT AS epoch, substr(sha256(user_id || '|' || codes || '|' || epoch), 1, 24) AS fingerprint FROM r WHERE k = 1""")
def str09_alert_dedupe(s, d):
    st = T(s, d, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("codes"), (F.col("value") >= 30).alias("ok"))
    return R.alert_epochs(st, "user_id", ["ts", "event_id"]).select("event_id", "epoch", "fingerprint")


@q("SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def str11_bijection(s, d):
    return R.check_bijection(T(s, d, "documents"), T(s, d, "labels"), "doc_id")


@q("SELECT doc_id, sha256(text) <> sha256(CASE WHEN doc_id % 9 = 0 THEN text || 'x' ELSE text END) AS stale FROM documents")
def str12_drift(s, d):
    t = T(s, d, "documents").select("doc_id", "text")
    audited = F.sha2(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary"), 256)
    return t.select("doc_id", (F.sha2(F.col("text").cast("binary"), 256) != audited).alias("stale"))


@q("SELECT y, sum(c) OVER (ORDER BY y)::BIGINT AS revealed FROM (SELECT year(o_orderdate) AS y, count(*) AS c FROM orders GROUP BY 1)")
def str16_monotone_reveal(s, d):
    g = T(s, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(n().alias("c"))
    return g.select("y", F.sum("c").over(Window.orderBy("y")).alias("revealed"))  # one row a year


# --- sinks, in effect ----------------------------------------------------------------------------


@q("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'N' ELSE o_orderstatus END AS status FROM orders")
def snk05_upsert(s, d):
    old = T(s, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = old.filter("o_orderkey % 4 = 0").withColumn("status", F.lit("N"))
    return O.upsert(old, new, "o_orderkey")


@q("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN false ELSE true END AS display FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey IN (SELECT o_custkey FROM orders)""")
def snk08_retention(s, d):
    old = T(s, d, "customer").select("c_custkey", F.lit(True).alias("display"))
    ref = T(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return O.retain(old, old.filter("c_custkey % 3 <> 0"), "c_custkey", [ref], {"display": F.lit(False)})


@q("SELECT s_suppkey, CASE WHEN n_regionkey = 1 THEN 0.0 ELSE s_acctbal END AS balance FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def snk09_correlated_update(s, d):
    j = T(s, d, "supplier").join(T(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.select("s_suppkey", F.when(F.col("n_regionkey") == 1, 0.0).otherwise(F.col("s_acctbal")).alias("balance"))


@q("SELECT doc_id, coalesce(quality, 0) = 1 AS display, coalesce(quality, 0) = 1 AND coalesce(toxic, 1) = 0 AS citation FROM documents LEFT JOIN labels USING (doc_id)")
def snk11_fail_closed(s, d):
    j = T(s, d, "documents").select("doc_id").join(T(s, d, "labels"), "doc_id", "left")
    show = F.coalesce(F.col("quality") == 1, F.lit(False))
    return j.select("doc_id", show.alias("display"), (show & F.coalesce(F.col("toxic") == 0, F.lit(False))).alias("citation"))


@q("SELECT count(*) AS rows, 0::BIGINT AS differences FROM nation")
def snk12_versioned_publish(s, d):
    """Stage a release, verify it, swap the pointer, read it back through the pointer."""
    from quarrylight.release import publish, read_release

    root = shared_folder(s)
    nation = T(s, d, "nation")
    publish(nation, root, ["n_nationkey"])
    back = read_release(s, root)
    return back.agg(n().alias("rows")).crossJoin(O.both_ways(nation, back).agg(n().alias("differences")))


# --- graphs --------------------------------------------------------------------------------------


@q("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), u AS (SELECT doc_id, i, trim(regexp_replace(line, '[ \\t]+', ' ', 'g'), ' ') AS body FROM l)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS ordinal, sha256(body) AS sha FROM u WHERE length(body) BETWEEN 24 AND 2200 AND len(regexp_extract_all(body, '[A-Za-z0-9]')) > 0.55 * length(body)""")
def grf01_corpus_build(s, d):
    """Paragraphs are normalised, gated and numbered within the row, each once: nothing is shuffled."""
    bodies = F.transform(F.split("text", "\n", -1), X.normalize_block)
    kept = F.filter(bodies, lambda b: F.length(b).between(24, 2200) & (X.meaningful_characters(b, "[A-Za-z0-9]") > 0.55 * F.length(b)))
    l = T(s, d, "documents").select("doc_id", F.posexplode(kept).alias("i", "body"))
    return l.select("doc_id", (F.col("i") + 1).cast("long").alias("ordinal"), F.sha2(F.col("body").cast("binary"), 256).alias("sha"))


SURFACES = ("tion", "with", "ment", "keit", "mente")


@q("""WITH s(concept) AS (VALUES ('tion'), ('with'), ('ment'), ('keit'), ('mente')), o AS (SELECT source, lang, concept, sum(((length(text) - length(replace(text, concept, ''))) / length(concept))::BIGINT)::BIGINT AS k, sum(n_chars)::BIGINT AS c FROM documents, s GROUP BY 1, 2, 3),
r AS (SELECT *, round(k / c * 10000, 4) AS rate FROM o WHERE k > 0) SELECT source, lang, concept, k, rate, round(0.28 + 0.72 * sqrt(rate / max(rate) OVER (PARTITION BY concept)), 4) AS strength FROM r""")
def grf02_observation_graph(s, d):
    docs = T(s, d, "documents")
    g = docs.groupBy("source", "lang").agg(F.sum("n_chars").alias("c"), *[F.sum(X.exact_count(F.col("text"), x).cast("long")).alias(x) for x in SURFACES])
    o = g.unpivot(["source", "lang", "c"], list(SURFACES), "concept", "k").filter("k > 0").withColumn("rate", O.rate(F.col("k"), F.col("c")))
    return o.select("source", "lang", "concept", "k", "rate", X.root_strength(F.col("rate"), F.max("rate").over(Window.partitionBy("concept"))).alias("strength"))


@q("""WITH p AS (SELECT r_name, n_name, c_mktsegment, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)
SELECT r_name, string_agg(n_name || '/' || c_mktsegment || ':' || k, ',' ORDER BY n_name, c_mktsegment) AS tree, sum(k)::BIGINT AS total FROM p GROUP BY 1""")
def grf10_drill_down(s, d):
    j = T(s, d, "customer").join(T(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(T(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    p = j.groupBy("r_name", "n_name", "c_mktsegment").agg(n().alias("k"))
    node = F.struct("n_name", "c_mktsegment", "k")
    g = p.groupBy("r_name").agg(F.sort_array(F.collect_list(node)).alias("t"), F.sum("k").alias("total"))
    return g.select("r_name", F.array_join(F.transform("t", lambda x: F.concat(x["n_name"], F.lit("/"), x["c_mktsegment"], F.lit(":"), x["k"].cast("string"))), ",").alias("tree"), "total")


@q("""WITH c AS (SELECT source, sha256(text) AS sha, max(n_chars) AS chars FROM documents GROUP BY 1, 2) SELECT source, count(*) AS unique_texts, sum(chars)::BIGINT AS chars FROM c GROUP BY 1""")
def grf11_coverage_ledger(s, d):
    c = T(s, d, "documents").groupBy("source", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.max("n_chars").alias("chars"))
    return c.groupBy("source").agg(n().alias("unique_texts"), F.sum("chars").alias("chars"))


@q("""WITH x AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 1 WHEN quality = 0 THEN 2 ELSE 3 END AS p, lang FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, p AS priority, row_number() OVER (PARTITION BY lang ORDER BY p, doc_id) AS place FROM x WHERE p < 3""")
def grf12_review_queue(s, d):
    j = T(s, d, "documents").select("doc_id", "lang").join(T(s, d, "labels"), "doc_id", "left")
    x = j.withColumn("priority", F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 2).otherwise(3)).filter("priority < 3")
    return x.select("doc_id", "priority", F.row_number().over(Window.partitionBy("lang").orderBy("priority", "doc_id")).cast("long").alias("place"))


@q("""SELECT change, count(*) AS n FROM (SELECT CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'updated' ELSE 'unchanged' END AS change
FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0) a FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN upper(lang) ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0) b ON a.doc_id = b.doc_id) GROUP BY 1""")
def grf13_release_diff(s, d):
    t = T(s, d, "documents").select("doc_id", "text", "lang")
    a = t.filter("doc_id % 10 <> 0").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    b = t.filter("doc_id % 11 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.upper("lang")).otherwise(F.col("text")).cast("binary"), 256).alias("h"))
    return O.diff(a, b, "doc_id", ["h"]).groupBy("change").agg(n().alias("n"))


@q("""SELECT substr(sha256(url), 1, 16) AS id, url, length(html) AS bytes FROM pages""")
def grf14_catalog(s, d):
    return T(s, d, "pages").select(X.compact_id(F.col("url"), length=16).alias("id"), "url", F.length("html").cast("long").alias("bytes"))


@q("""SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS actions, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1""")
def grf15_operations_ledger(s, d):
    return T(s, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), n().alias("actions"), F.count_distinct("event_type").alias("kinds"))


@q("""WITH c AS (SELECT c_nationkey AS fam, o_orderkey AS id, year(o_orderdate) AS y, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fam, y ORDER BY v DESC, id) AS r FROM c) WHERE r = 1), e AS (SELECT fam, lag(id) OVER (PARTITION BY fam ORDER BY y) AS source, id AS target, y - lag(y) OVER (PARTITION BY fam ORDER BY y) AS gap FROM t)
SELECT fam, source, target, gap FROM e WHERE source IS NOT NULL""")
def grf09_families(s, d):
    """The strongest observation of each family and year, linked through the years."""
    c = T(s, d, "orders").join(T(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("fam"), F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("y"), F.col("o_totalprice").alias("v"))
    top = O.first_per_key(c, ["fam", "y"], F.desc("v"), "id")
    w = Window.partitionBy("fam").orderBy("y")
    return top.select("fam", F.lag("id").over(w).alias("source"), F.col("id").alias("target"), (F.col("y") - F.lag("y").over(w)).alias("gap")).filter("source IS NOT NULL")
