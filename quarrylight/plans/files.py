"""File sources, sinks and probes over files that the queries write to the shared folder first, damaged ones among them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight import functions as X
from quarrylight import operators as O
from quarrylight import release, sources
from quarrylight.operators import jsonschema as J
from quarrylight.session import shared_folder, ship, written
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


# --- sources -------------------------------------------------------------------------------------



def page_tree(s, d) -> tuple[str, list]:
    """A page a nation, a document a region: 25 small files. The one of nation 7 is changed after its hash was recorded, that of nation 24 is lost, one has no record."""
    root = shared_folder(s)
    rows = [(f"R{r['n_regionkey']}", r["n_nationkey"] // 5 + 1, r["n_name"], r["n_nationkey"]) for r in T(s, d, "nation").collect()]  # a fixed dimension
    for doc, page, name, k in rows:
        if k != 24:
            sources.put_text(s, f"{root}/{doc}/pages/{page:03d}/page.md", name + ("!" if k == 7 else ""))
    sources.put_text(s, f"{root}/R0/pages/009/page.md", "nobody's")
    sources.put_text(s, f"{root}/R0/notes.txt", "not a page")
    return root, rows


@q("""SELECT 'R' || n_regionkey AS document, (n_nationkey // 5 + 1)::INT AS page, 'hash' AS problem FROM nation WHERE n_nationkey = 7 UNION ALL SELECT 'R' || n_regionkey, (n_nationkey // 5 + 1)::INT, 'missing' FROM nation WHERE n_nationkey = 24
UNION ALL SELECT 'R0', 9, 'unknown' UNION ALL SELECT 'R0', NULL, 'numbering'""")
def src04_page_tree(s, d):
    """A tree of pages bound to the hashes recorded for them; every fault is named."""
    root, rows = page_tree(s, d)
    state = s.createDataFrame([(doc, page, name) for doc, page, name, _ in rows], "document string, page int, name string").select("document", "page", F.sha2(F.col("name").cast("binary"), 256).alias("sha256"))
    return sources.bind_pages(sources.read_page_directory(s, root).select("document", "page", "sha256"), state)


@q("""SELECT 'side/doc-' || n_nationkey || '.review.json' AS file, n_nationkey::VARCHAR AS id, 'accepted' AS state FROM nation WHERE n_nationkey % 3 <> 0
UNION ALL SELECT 'side/doc-' || n_nationkey || '.review.json.bak', NULL, 'ignored' FROM nation WHERE n_nationkey % 3 = 0""")
def src05_sidecars(s, d):
    root = shared_folder(s)
    for r in T(s, d, "nation").select("n_nationkey").collect():  # a fixed dimension
        k = r["n_nationkey"]
        sources.put_text(s, f"{root}/side/doc-{k}.review.json{'' if k % 3 else '.bak'}", "{}")
    return sources.sidecars(sources.read_tree(s, root), r"doc-([0-9]+)\.review\.json")


@q("""SELECT 'R' || n_regionkey || '/pages/' || lpad((n_nationkey // 5 + 1)::VARCHAR, 3, '0') || '/page.md' AS file, length(n_name) + (n_nationkey = 7)::INT AS bytes FROM nation WHERE n_nationkey <> 24
UNION ALL SELECT 'R0/pages/009/page.md', 8 UNION ALL SELECT 'R0/notes.txt', 10""")
def src13_file_tree(s, d):
    return sources.read_tree(s, page_tree(s, d)[0])


_HREF = "CASE p_partkey % 4 WHEN 0 THEN '/d/' || p_partkey || '.pdf' WHEN 1 THEN 'https://other.example/x' || p_partkey || '.DOCX' WHEN 2 THEN '/d/' || p_partkey || '.html' ELSE 'd/' || (p_partkey - p_partkey % 12) || '.zip' END"


@q(f"""WITH a AS (SELECT p_partkey, p_name, {_HREF} AS href FROM part WHERE p_partkey % 4 <> 2),
u AS (SELECT p_partkey, p_name || ' ' || p_partkey AS title, CASE WHEN href LIKE 'https:%' THEN href WHEN href LIKE '/%' THEN 'https://host.example' || href ELSE 'https://host.example/' || href END AS url, lower(regexp_extract(href, '[.]([^.]+)$', 1)) AS format FROM a)
SELECT arg_min(title, p_partkey) AS title, url, min(format) AS format FROM u GROUP BY url""")
def src07_html_links(s, d):
    """Pages of ten links each; those to HTML are none, those that come again count once."""
    p = T(s, d, "part").select("p_partkey", "p_name", F.expr(_HREF).alias("href"))
    a = F.concat(F.lit('<li><a class="c" href="'), "href", F.lit('" target="_blank"><div class="t">\n <b>'), "p_name", F.lit("</b>  "), F.col("p_partkey").cast("string"), F.lit("</div></a></li>"))
    page = p.groupBy(F.floor(F.col("p_partkey") / 10).alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", F.when(F.col("href").endswith("html"), F.concat(F.lit('<a href="'), "href", F.lit('">x</a>'))).otherwise(a).alias("a")))), lambda x: x["a"]), "\n").alias("html"))
    return sources.document_links(page, "page", "html", "https://host.example/")


@q("SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE p_size::BIGINT END AS pages FROM part")
def src08_pagination(s, d):
    size = F.col("p_size").cast("string")
    one = F.concat(F.lit('<a id="btn_new" class="p" data-max="'), size, F.lit('">next</a>'))
    two = F.concat(F.lit('<a data-max="'), size, F.lit('" id="btn_new">next</a>'))
    html = F.when(F.col("p_partkey") % 3 == 0, one).when(F.col("p_partkey") % 3 == 1, two).otherwise(F.lit('<a data-max="9">x</a>'))
    return T(s, d, "part").select("p_partkey", sources.page_count(html).alias("pages"))


@q("SELECT s AS start, least(s + 1000, (SELECT sum(p_size) FROM part))::BIGINT AS \"end\" FROM (SELECT unnest(range(0, (SELECT sum(p_size) FROM part)::BIGINT, 1000)) AS s) WHERE s % 3000 <> 0")
def src11_byte_ranges(s, d):
    """What is still to fetch of a file of so many bytes, a third of it done."""
    size = T(s, d, "part").agg(F.sum("p_size")).first()[0]
    return sources.download_ranges(s, size, s.range(0, size, 3000).select(F.col("id").alias("start")), 1000)


@q("SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE regexp_matches(event_type, '^(click|view)') GROUP BY 1")
def src16_event_log(s, d):
    path = shared_folder(s)
    T(s, d, "events").select("event_id", "event_type", "ts").write.json(path)
    log = sources.read_log(s, path, "event_id long, event_type string, ts string")
    return log.filter(F.col("event_type").rlike("^(click|view)")).groupBy("event_type").agg(n().alias("n"), F.min("event_id").alias("first_id"))


@q("SELECT count(*) AS rows, sum(n_regionkey)::BIGINT AS keys, (SELECT count(*) FROM region) AS fallback FROM nation")
def src17_pointer(s, d):
    """The last of two releases; a folder that never had one falls back."""
    root = shared_folder(s)
    nation = T(s, d, "nation")
    release.publish(nation.filter("n_nationkey < 10"), root, ["n_nationkey"])
    release.publish(nation, root, ["n_nationkey"])
    other = release.read_release(s, shared_folder(s), f"{d}/region.parquet").agg(n().alias("fallback"))
    return release.read_release(s, root).agg(n().alias("rows"), F.sum("n_regionkey").alias("keys")).crossJoin(other)


@q("""SELECT event_id, event_type AS active_state, user_id AS n_restarts, (event_id % 7 - 3)::BIGINT AS exec_main_status, event_id AS main_pid, event_id * 3 * 1024 AS available, 2 AS devices, greatest(user_id, 50)::DOUBLE AS hottest, (event_id + 7)::DOUBLE AS used,
CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'Not Active|' || event_type END AS reasons, 2 AS readings, greatest(user_id + 0.5, 41)::DOUBLE AS temperature FROM events""")
def src19_probes(s, d):
    """Five kinds of probe text, parsed to numbers."""
    c = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    show = c("LoadState=loaded\nActiveState=", kind, "\nSubState=a=b\nNRestarts=", u, "\nExecMainStatus=", e % 7 - 3, "\nMainPID=", e, "\nResult=ok\n")
    memory = c("MemTotal:  99 kB\nMemAvailable:   ", e * 3, " kB\nSwapFree: 1 kB\n")
    gpu = c(u, ", 3, ", e, ", 900\n50, 4, 7, 900\n")
    why = F.when(e % 5 == 0, F.lit("\n")).otherwise(c("Not Active\n", kind, "\n"))
    heat = c('{"coretemp-isa-0000": {"Adapter": "ISA", "Core 0": {"temp2_input": ', u, '.5, "temp2_max": 100.0}, "Core 1": {"temp3_input": 41}}, "nvme-1": {"Composite": {"temp1_input": 99999}}}')
    t = T(s, d, "events").select("event_id", sources.systemd_show(show).alias("s"), sources.meminfo(memory).alias("available"), sources.gpu_table(gpu).alias("g"), F.array_join(sources.throttle_reasons(why), "|").alias("reasons"), sources.sensors(heat).alias("h"))
    return t.select(
        "event_id", "s.active_state", "s.n_restarts", "s.exec_main_status", "s.main_pid", "available", "g.devices", F.col("g.max_temperature_c").alias("hottest"), F.col("g.memory_used_mib").alias("used"),
        "reasons", "h.readings", F.col("h.max_temperature_c").alias("temperature"),
    )


# --- sinks ---------------------------------------------------------------------------------------


@q("SELECT count(*) AS rows, ceil(count(*) / 250)::BIGINT AS chunks, least(250, count(*)) AS most, 0::BIGINT AS unsound FROM part")
def snk01_chunked_writer(s, d):
    """Chunks of 250 records, each written by one task, and a manifest of names, hashes, bytes and rows that the files are held against again."""
    path = shared_folder(s)
    placed = O.ordinals(T(s, d, "part"), ["p_partkey"], "place")
    placed.withColumn("chunk", F.floor((F.col("place") - 1) / 250)).repartition("chunk").write.partitionBy("chunk").parquet(path)

    def manifest():
        # a task gives its files in several chunks' folders one name
        files = s.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
        sums = files.select(F.substring_index("path", "/", -2).alias("name"), F.sha2("content", 256).alias("sha"), F.col("length").alias("bytes"))
        rows = s.read.parquet(path).groupBy(F.substring_index("_metadata.file_path", "/", -2).alias("name")).agg(n().alias("rows"))
        return sums.join(rows, "name")

    kept = written(manifest())
    unsound = O.both_ways(kept, manifest()).agg(n().alias("unsound"))
    return kept.agg(F.sum("rows").alias("rows"), n().alias("chunks"), F.max("rows").alias("most")).crossJoin(unsound)


@q("SELECT 3::BIGINT AS artifacts, count(*) AS rows, 0::BIGINT AS parts FROM nation")
def snk02_atomic_artifact(s, d):
    """Three releases one after the other: three pointers, the last whole, nothing half-written left."""
    root = shared_folder(s)
    for _ in range(3):
        release.publish(T(s, d, "nation"), root, ["n_nationkey"])
    files = sources.read_tree(s, f"{root}/pointers")
    counts = files.agg(F.count_if(F.col("file").endswith(".json")).alias("artifacts"), F.count_if(F.col("file").contains(".part")).alias("parts"))
    return counts.crossJoin(release.read_release(s, root).agg(n().alias("rows"))).select("artifacts", "rows", "parts")


@q("SELECT 0::BIGINT AS same, 2::BIGINT AS damaged")
def snk03_deterministic_rebuild(s, d):
    """A rebuild from other partitions differs in nothing from the stored artifact, and in both rows of one that was changed."""
    def build(parts):
        return T(s, d, "orders").repartition(parts, "o_orderkey").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("t"), n().alias("c"))

    stored = written(build(3))
    least = stored.agg(F.min("o_custkey").alias("k"))
    changed = stored.crossJoin(F.broadcast(least)).withColumn("c", F.col("c") + (F.col("o_custkey") == F.col("k")).cast("long")).drop("k")
    again = build(5)
    return O.both_ways(stored, again).agg(n().alias("same")).crossJoin(O.both_ways(changed, again).agg(n().alias("damaged")))


@q("SELECT '2024-01-01' AS kept, '2024-02-02' AS renewed")
def snk04_generated_at(s, d):
    """The time of a build stays if nothing else differs, and is new if something does."""
    old = T(s, d, "nation").withColumn("generated_at", F.lit("2024-01-01"))
    new = old.withColumn("generated_at", F.lit("2024-02-02"))
    other = new.withColumn("n_name", F.when(F.col("n_nationkey") == 3, F.lit("x")).otherwise(F.col("n_name")))
    a, b = release.keep_generated_at(old, new), release.keep_generated_at(old, other)
    return a.agg(F.max("generated_at").alias("kept")).crossJoin(b.agg(F.max("generated_at").alias("renewed")))


@q("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def snk07_increment(s, d):
    """Stored counters, and the increments of the events that came since."""
    e = T(s, d, "events")
    stored = written(e.filter("event_id % 2 = 0").groupBy("user_id", "event_type").agg(n().alias("n")))
    more = e.filter("event_id % 2 = 1").groupBy("user_id", "event_type").agg(n().alias("more"))
    j = stored.join(more, ["user_id", "event_type"], "full_outer")
    return j.select("user_id", "event_type", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))


@q("SELECT event_type AS action, count(*) AS rows, count(DISTINCT sha256(props)) AS queries FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def snk13_append_log(s, d):
    """Rows are appended in two writes, their queries as hashes."""
    path = shared_folder(s)
    e = T(s, d, "events").select(F.col("event_type").alias("action"), F.sha2(F.col("props").cast("binary"), 256).alias("query_hash"))
    for action in ("click", "view"):
        e.filter(F.col("action") == action).write.mode("append").parquet(path)
    return s.read.schema(e.schema).parquet(path).groupBy("action").agg(n().alias("rows"), F.count_distinct("query_hash").alias("queries"))


# --- gates and search ----------------------------------------------------------------------------


@q("SELECT (SELECT count(*) FROM region) AS roots, 2::BIGINT AS cycles, 1::BIGINT AS depth FROM region LIMIT 1")
def gat21_ontology(s, d):
    """Regions, their nations, and two nodes that are each other's parent."""
    r = T(s, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    nat = T(s, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("node"), F.concat(F.lit("R"), "n_regionkey").alias("parent"))
    bad = s.createDataFrame([("X", "Y"), ("Y", "X")], "node string, parent string")
    c = O.closure(s, r.unionAll(nat).unionAll(bad), "node", "parent")
    sound = ~F.col("cyclic")
    return c.agg(F.count_if(sound & (F.col("depth") == 0)).alias("roots"), F.count_if("cyclic").alias("cycles"), F.max(F.when(sound, F.col("depth"))).cast("long").alias("depth"))


@q("""SELECT o_orderkey, '$.unlock' AS path FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, '$.parts[0].unlock' FROM orders UNION ALL SELECT o_orderkey, '$.parts[1].deep.unlock' FROM orders""")
def gat26_key_paths(s, d):
    """Every place at which a key stands in nested JSON."""
    ship(s)
    deep = F.concat(F.lit('"parts": [{"unlock": 1}, {"deep": {"unlock": {"a": []}}}], "o": '), F.col("o_orderkey").cast("string"), F.lit("}"))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{"unlock": null, '), deep)).otherwise(F.concat(F.lit("{"), deep))
    return T(s, d, "orders").select("o_orderkey", F.explode(J.key_paths_udf("unlock")(text)).alias("path"))


def dice_gate(one, two, confidence, lines, low):
    """The status of a page from two readings of it (GAT-06): blank, pass, or review."""
    years = lambda c: F.array_join(F.sort_array(F.array_distinct(F.regexp_extract_all(c, F.lit("((?:18|19|20)[0-9]{2})"), F.lit(1)))), ",")
    ratio = F.when(lines > 0, low / lines).otherwise(0.0)
    passed = (F.coalesce(confidence, F.lit(0.0)) >= 0.85) & (ratio <= 0.15) & (years(one) == years(two)) & (X.dice(one, two) >= 0.92)  # the dearest last
    return F.when(F.greatest(F.length(one), F.length(two)) < 10, "blank_or_image_only").when(passed, "machine_pass").otherwise("manual_review_required")


@q("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'blank_or_image_only' WHEN o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 13 = 0 THEN 'manual_review_required' ELSE 'machine_pass' END AS status FROM orders""")
def gat06_dice_gate(s, d):
    """Readings that are equal, but for a year (5), a word (11), with low confidence (3) or many poor lines (13)."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("the order of the year "), F.year("o_orderdate").cast("string"), F.lit(" was read twice, line by line, by two engines, number "), k.cast("string"))
    one = F.when(k % 7 == 0, F.lit("x")).otherwise(text)
    two = F.when(k % 7 == 0, F.lit("")).when(k % 5 == 0, F.regexp_replace(text, "year (....)", "year 1850")).when(k % 11 == 0, F.replace(text, F.lit("line by line, by two engines"), F.lit("and never again by any"))).otherwise(text)
    low = F.when(k % 13 == 0, 16).otherwise(15)
    # a task for each few rows of a compact file, as a row takes long
    o = T(s, d, "orders").select("o_orderkey", "o_orderdate").repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    read = o.select("o_orderkey", one.alias("one"), two.alias("two"))
    return read.select("o_orderkey", dice_gate(F.col("one"), F.col("two"), F.when(k % 3 == 0, 0.84).otherwise(0.85), F.lit(100), low).alias("status"))


@q("""SELECT 'document' AS kind, doc_id::VARCHAR AS id, min(subject) AS subject, row_number() OVER (PARTITION BY 1 ORDER BY min(y), min(subject), doc_id) AS place FROM (SELECT doc_id, source AS subject, n_chars % 30 AS y FROM documents WHERE source IN ('src1', 'src2', 'src11')) GROUP BY doc_id
UNION ALL SELECT 'insight', item_id::VARCHAR, min(subject), row_number() OVER (ORDER BY item_id) FROM (SELECT item_id, CASE WHEN item_id % 4 = 3 THEN 'general' ELSE 'src' || (item_id % 4) END AS subject FROM benchmark) WHERE subject IN ('src1', 'src2', 'src11', 'general') GROUP BY item_id""")
def fts07_comparison(s, d):
    """A fan-out over the subjects of a facet: each gives its documents, and its insights with the shared ones; what several give counts once."""
    docs = T(s, d, "documents").select("doc_id", F.col("source").alias("subject"), (F.col("n_chars") % 30).alias("y"))
    ins = T(s, d, "benchmark").select("item_id", F.when(F.col("item_id") % 4 == 3, "general").otherwise(F.concat(F.lit("src"), (F.col("item_id") % 4).cast("string"))).alias("subject"))
    plan = ["src1", "src2", "src11"]
    every = None, None
    for x in plan:
        parts = docs.filter(F.col("subject") == x), ins.filter(F.col("subject").isin(x, "general"))
        every = tuple(p if e is None else e.unionAll(p) for e, p in zip(every, parts))
    a = O.first_per_key(every[0], "doc_id", "y", "subject").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), "subject", F.row_number().over(Window.orderBy("y", "subject", "doc_id")).cast("long").alias("place"))
    b = O.first_per_key(every[1], "item_id", "subject")
    return a.unionAll(b.select(F.lit("insight"), F.col("item_id").cast("string"), "subject", F.row_number().over(Window.orderBy("item_id")).cast("long")))
