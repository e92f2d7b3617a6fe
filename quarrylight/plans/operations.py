"""Archives, fetches, transactions, locks, schedules and records of alerts. Query names begin with the operators' ids."""

from __future__ import annotations

import io
import tarfile

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight import operators as O
from quarrylight import release
from quarrylight.session import shared_folder
from quarrylight.session import table as T
from quarrylight.sources import put_text, remote
from quarrylight.streaming import jobs

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


def put_bytes(s, path: str, data: bytes) -> None:
    """A small file, written by the driver."""
    p = s.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data))
    out.close()


# --- sources -------------------------------------------------------------------------------------


@q("SELECT 'region-' || n_regionkey || '.tar.gz' AS archive, 'pages/' || n_nationkey || '.md' AS member, length(n_name)::INT AS bytes, sha256(n_name) AS sha FROM nation")
def src06_archives(s, d):
    """An archive a region with a page a nation, unpacked once its bytes are those of the sums file."""
    import hashlib

    root, lines, by = shared_folder(s), [], {}
    for r in T(s, d, "nation").collect():  # a fixed dimension
        by.setdefault(r["n_regionkey"], []).append((f"pages/{r['n_nationkey']}.md", r["n_name"].encode()))
    for k, files in by.items():
        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode="w:gz") as t:
            for name, body in files:
                x = tarfile.TarInfo(name)
                x.size = len(body)
                t.addfile(x, io.BytesIO(body))
        put_bytes(s, f"{root}/archives/region-{k}.tar.gz", buffer.getvalue())
        lines.append(f"{hashlib.sha256(buffer.getvalue()).hexdigest()}  region-{k}.tar.gz\n")
    put_text(s, f"{root}/SHA256SUMS", "".join(lines))
    out = remote.read_archives(s, f"{root}/archives", remote.read_sums(s, f"{root}/SHA256SUMS"), "*.tar.gz")
    return out.select("archive", "member", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha"))


@q("""SELECT n_nationkey, run, CASE WHEN n_nationkey % 5 = 0 THEN 'failed' WHEN run = 2 AND n_nationkey % 2 = 0 THEN 'present' ELSE 'fetched' END AS state,
CASE WHEN n_nationkey % 5 = 0 THEN 4 WHEN run = 2 AND n_nationkey % 2 = 0 THEN 0 ELSE 1 END AS attempts FROM nation, (VALUES (1), (2)) r(run) WHERE run = 2 OR n_nationkey % 2 = 0""")
def src10_fetch(s, d):
    """Half of the URLs, then all of them: what is stored is not asked for again, what can't be had is tried four times in each run."""
    name = F.concat(F.lit("data:text/plain"), F.when(F.col("n_nationkey") % 5 == 0, F.lit("")).otherwise(F.lit(",")), F.replace("n_name", F.lit(" "), F.lit("%20")))
    urls = T(s, d, "nation").select("n_nationkey", name.alias("url"))
    store = shared_folder(s)
    runs = [remote.fetch(x.select("url"), store, tasks=2).withColumn("run", F.lit(i)) for i, x in ((1, urls.filter("n_nationkey % 2 = 0")), (2, urls))]
    return urls.join(runs[0].unionAll(runs[1]), "url").select("n_nationkey", "run", "state", "attempts")


# --- sinks ---------------------------------------------------------------------------------------


@q("SELECT 'R' || n_regionkey AS document, count(*) AS pages, 1::BIGINT AS receipts, false AS staged FROM nation WHERE n_regionkey <= 2 GROUP BY 1")
def snk14_install(s, d):
    """Regions 0 to 2 are installed; a second transaction, of 2 to 4, meets the region that is there and leaves nothing."""
    root = shared_folder(s)
    pages = T(s, d, "nation").select(F.concat(F.lit("R"), "n_regionkey").alias("document"), F.col("n_nationkey").alias("page"), F.col("n_name").alias("body"), "n_regionkey")
    release.install(pages.filter("n_regionkey <= 2").drop("n_regionkey"), root, "first")
    try:
        release.install(pages.filter("n_regionkey >= 2").drop("n_regionkey"), root, "second")
    except FileExistsError:
        pass
    files = s.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.substring_index("path", root.removeprefix("file://") + "/", -1).alias("file"))
    about = files.agg(F.count_if(F.col("file").startswith("receipts/") & F.col("file").endswith(".json")).alias("receipts"), (F.count_if(F.col("file").startswith("staging")) > 0).alias("staged"))
    return s.read.schema("page int, body string, document string").parquet(f"{root}/documents").groupBy("document").agg(n().alias("pages")).crossJoin(F.broadcast(about))


# --- jobs ----------------------------------------------------------------------------------------


_WORK = """w AS (SELECT p_partkey, p_brand AS document, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS page, p_size FROM part),
p AS (SELECT document, min(p_size) AS priority FROM w GROUP BY 1), c AS (SELECT * FROM (VALUES ('none', NULL), ('middle', 'Brand#3'), ('last', 'Brand#99')) c(step, cursor)),
l AS (SELECT *, CASE WHEN p_size = 50 THEN 3 WHEN p_size = 49 THEN 2 ELSE 1 END AS lane FROM w WHERE p_size >= 48), h AS (SELECT document, lane FROM l ORDER BY document, lane LIMIT 1)"""


@q(f"""WITH {_WORK}, pool AS (SELECT document FROM p WHERE priority = (SELECT min(priority) FROM p)),
t AS (SELECT step, coalesce((SELECT min(document) FROM pool WHERE document > cursor), (SELECT min(document) FROM pool)) AS document FROM c)
SELECT step, w.document, 'new' AS mode, page FROM t JOIN w USING (document) WHERE page <= 3
UNION ALL SELECT 'recovery', document, CASE lane WHEN 1 THEN 'primary' WHEN 2 THEN 'witness' ELSE 'audit' END, page FROM (SELECT l.*, row_number() OVER (ORDER BY page) AS r FROM l JOIN h USING (document, lane)) WHERE r <= 3""")
def str04_next_batch(s, d):
    """A brand is a document, its parts are pages: the turns of new work from three cursors, and what goes before new work."""
    page = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("long")
    w = T(s, d, "part").select("p_partkey", F.col("p_brand").alias("document"), page.alias("page"), "p_size")
    fresh = w.join(w.groupBy("document").agg(F.min("p_size").alias("priority")), "document")
    lane = F.when(F.col("p_size") == 50, 3).when(F.col("p_size") == 49, 2).otherwise(1)
    mode = F.element_at(F.array(*map(F.lit, ("primary", "witness", "audit"))), lane)
    recovery = w.filter("p_size >= 48").select("document", F.col("document").alias("position"), lane.alias("lane"), mode.alias("mode"), "page")
    steps = [(step, jobs.next_batch(recovery.limit(0), fresh, cursor, 3)) for step, cursor in (("none", None), ("middle", "Brand#3"), ("last", "Brand#99"))]
    steps.append(("recovery", jobs.next_batch(recovery, fresh, None, 3)))
    out = None
    for step, df in steps:
        one = df.select(F.lit(step).alias("step"), "document", "mode", "page")
        out = one if out is None else out.unionAll(one)
    return out


@q("""WITH x AS (SELECT user_id, event_id, ts, NOT (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 2) AS closed FROM events),
y AS (SELECT *, count(*) OVER (PARTITION BY user_id) - 4 AS excess, sum(closed::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS r FROM x) SELECT event_id, closed FROM y WHERE NOT (closed AND r <= excess)""")
def str09_record_eviction(s, d):
    """Four records a user at most, the last two of them open."""
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    r = T(s, d, "events").select("user_id", "event_id", "ts", (last > 2).alias("closed"))
    return jobs.keep_records(r, ["user_id"], ["ts", "event_id"], 4).select("event_id", "closed")


@q("""SELECT event_id, floor(epoch(ts))::BIGINT - floor(epoch(coalesce(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '2024-01-01'))) >= 120 AS due FROM events""")
def str13_cadence(s, d):
    """Runs of each user: due two minutes after the one before, the first two minutes after the start."""
    e = T(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("event_id", jobs.due(F.col("ts"), before, F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("due"))


@q("SELECT n_regionkey AS region, min(n_nationkey)::BIGINT AS first_owner, count(*) - 1 AS refused, max(n_nationkey)::BIGINT AS second_owner FROM nation GROUP BY 1")
def str14_single_owner(s, d):
    """All nations of a region want its lock: one has it, the others are refused; once it is released the last one gets it."""
    root, rows = shared_folder(s), {}
    for r in T(s, d, "nation").orderBy("n_nationkey").collect():  # a fixed dimension
        k, who = r["n_regionkey"], r["n_nationkey"]
        lock = jobs.Lock(s, f"{root}/lock-{k}", str(who))
        row = rows.setdefault(k, {"first": None, "refused": 0, "locks": []})
        row["locks"].append((who, lock))
        try:
            lock.acquire()
            row["first"] = (who, lock)
        except jobs.Busy:
            row["refused"] += 1
    out = []
    for k, row in rows.items():
        row["first"][1].release()
        who, lock = row["locks"][-1]
        lock.acquire()
        lock.release()
        out.append((k, row["first"][0], row["refused"], who))
    return s.createDataFrame(out, "region int, first_owner long, refused long, second_owner long")


# --- gates ---------------------------------------------------------------------------------------


@q("""WITH o AS (SELECT o_orderpriority AS facet, o_orderstatus AS tier, count(*) AS n FROM orders GROUP BY 1, 2), f AS (SELECT DISTINCT o_orderpriority AS facet FROM orders), t AS (SELECT DISTINCT o_orderstatus AS tier FROM orders UNION SELECT 'X')
SELECT facet, tier, coalesce(n, 0) AS n, n IS NULL AS missing FROM f CROSS JOIN t LEFT JOIN o USING (facet, tier)""")
def gat13_completeness(s, d):
    """The matrix of facets and tiers; every cell that nothing fills is a violation. Both sides are fixed lists of a few names."""
    o = T(s, d, "orders").groupBy(F.col("o_orderpriority").alias("facet"), F.col("o_orderstatus").alias("tier")).agg(n().alias("n"))
    tiers = o.select("tier").union(s.createDataFrame([("X",)], "tier string")).distinct()
    cells = o.select("facet").distinct().crossJoin(F.broadcast(tiers))
    return cells.join(o, ["facet", "tier"], "left").select("facet", "tier", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


_GRAPH = """e AS (SELECT l_orderkey AS source, l_partkey AS target, l_linenumber AS line, l_quantity AS v FROM lineitem UNION ALL SELECT -1, 1, 1, 1 UNION ALL SELECT o, -2, 1, 1 FROM (SELECT min(o_orderkey) AS o FROM orders) UNION ALL SELECT o, 1, 9, -5 FROM (SELECT max(o_orderkey) AS o FROM orders)),
u AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey = 0 THEN 1 WHEN n_nationkey = 1 THEN 0 WHEN n_nationkey >= 3 THEN 2 END AS parent FROM nation)"""


@q(f"""WITH {_GRAPH} SELECT 'source' AS "check", (SELECT count(*) FROM e WHERE source NOT IN (SELECT o_orderkey FROM orders)) AS violations UNION ALL SELECT 'target', (SELECT count(*) FROM e WHERE target NOT IN (SELECT p_partkey FROM part))
UNION ALL SELECT 'identity', (SELECT count(*) FROM (SELECT source, line FROM e GROUP BY 1, 2 HAVING count(*) > 1)) UNION ALL SELECT 'range', (SELECT count(*) FROM e WHERE v <= 0)
UNION ALL SELECT 'cycle', 2 UNION ALL SELECT 'visibility', (SELECT count(*) FROM orders WHERE (o_orderstatus = 'F') <> (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus <> 'F')))""")
def gat14_contract(s, d):
    """All failures of a graph: ends that are no nodes, edges that are there twice, values out of range, parents in a circle, and visibility that differs from what its edges make it."""
    o, li = T(s, d, "orders"), T(s, d, "lineitem")
    e = li.select(F.col("l_orderkey").cast("long").alias("source"), F.col("l_partkey").cast("long").alias("target"), F.col("l_linenumber").cast("int").alias("line"), F.col("l_quantity").cast("double").alias("v"))
    ends = o.agg(F.min("o_orderkey").cast("long").alias("lo"), F.max("o_orderkey").cast("long").alias("hi"))
    planted = F.array(*[F.struct(a.cast("long").alias("source"), F.lit(t).cast("long").alias("target"), F.lit(i).alias("line"), F.lit(v).cast("double").alias("v")) for a, t, i, v in ((F.lit(-1), 1, 1, 1), (F.col("lo"), -2, 1, 1), (F.col("hi"), 1, 9, -5))])
    e = e.unionAll(ends.select(F.inline(planted)))
    parent = F.when(F.col("n_nationkey") == 0, 1).when(F.col("n_nationkey") == 1, 0).when(F.col("n_nationkey") >= 3, 2)
    tree = O.closure(s, T(s, d, "nation").select("n_nationkey", parent.alias("parent")), "n_nationkey", "parent")
    made = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(F.col("l_linestatus") == "F").alias("made"))
    seen = o.join(made, "o_orderkey", "left").filter((F.col("o_orderstatus") == "F") != F.coalesce("made", F.lit(False)))
    return O.checks(
        ("source", e.join(o, F.col("source") == F.col("o_orderkey"), "left_anti")),
        ("target", e.join(T(s, d, "part"), F.col("target") == F.col("p_partkey"), "left_anti")),
        ("identity", e.groupBy("source", "line").count().filter("count > 1")),
        ("range", e.filter("v <= 0")),
        ("cycle", tree.filter("cyclic")),
        ("visibility", seen),
    ).select("check", "violations")
