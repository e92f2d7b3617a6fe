"""Readers with declared schemas that fail on what they do not know."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON under a declared schema; a record that does not parse aborts the read (SRC-01, SRC-16)."""
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)


def read_optional(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    """A table, or an empty one if the path is not there; any other error stays an error (SRC-02)."""
    try:
        return spark.read.schema(schema).format(format).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def pages(df: DataFrame, key: str, text: str, separator: str = "\f") -> DataFrame:
    """key, page (from 1), body of texts whose pages a separator parts (SRC-03)."""
    return df.select(key, F.posexplode(F.split(text, separator, -1)).alias("__p", "body")).select(key, (F.col("__p") + 1).cast("long").alias("page"), "body")


def read_paged_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, their pages parted by form feeds."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return pages(files, "file", "text")


def read_page_directory(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """document, page, sha256, content of <document>/pages/<number>/<file> trees (SRC-04, SRC-05, SRC-13)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    part = r"([^/]+)/pages/([0-9]+)/[^/]+$"
    return files.select(F.regexp_extract("path", part, 1).alias("document"), F.regexp_extract("path", part, 2).cast("int").alias("page"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("content"))


def links(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, href of every link of a page, without query and fragment (SRC-07)."""
    return df.select(key, F.explode(F.regexp_extract_all(html, F.lit(r'(?i)href="([^"#?]+)"'), F.lit(1))).alias("href"))


def download_ranges(spark: SparkSession, size: int, done: DataFrame, step: int = 16 << 20) -> DataFrame:
    """start, end of the byte ranges that are still to fetch (SRC-11); done: start."""
    every = spark.range(0, max(size, 0), step).select(F.col("id").alias("start"), F.least(F.col("id") + step, F.lit(size)).alias("end"))
    return every.join(done.select("start"), "start", "left_anti")


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written by the driver through Hadoop's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes of every file below a folder, by path relative to it; contents are not read (SRC-13). Spark's reader does not see files without a byte."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.removeprefix("file://").rstrip("/") + "/"
    return files.select(F.substring_index("path", root, -1).alias("file"), F.col("length").alias("bytes"))


def sidecars(files: DataFrame, pattern: str) -> DataFrame:
    """file, id, state: names that fit the pattern (whose first group is the id) are accepted, all others recorded as ignored (SRC-05)."""
    name = F.substring_index("file", "/", -1)
    fits = name.rlike(f"^(?:{pattern})$")
    return files.select("file", F.when(fits, F.regexp_extract(name, pattern, 1)).alias("id"), F.when(fits, "accepted").otherwise("ignored").alias("state"))


def bind_pages(pages: DataFrame, state: DataFrame) -> DataFrame:
    """document, problem: pages that are missing, unknown to the state, not numbered 1 to n, or whose content is another than its hash says (SRC-04).

    pages: document, page, sha256 as found; state: document, page, sha256 as recorded. Empty for a sound tree.
    """
    j = pages.withColumnRenamed("sha256", "__found").join(state.withColumnRenamed("sha256", "__want"), ["document", "page"], "full_outer")
    what = F.when(F.col("__found").isNull(), "missing").when(F.col("__want").isNull(), "unknown").when(F.col("__found") != F.col("__want"), "hash")
    each = j.select("document", "page", what.alias("problem")).filter("problem IS NOT NULL")
    n = F.count(F.lit(1))
    numbered = pages.groupBy("document").agg(n.alias("n"), F.min("page").alias("lo"), F.max("page").alias("hi"), F.count_distinct("page").alias("d"))
    gaps = numbered.filter("lo <> 1 OR hi <> n OR d <> n").select("document", F.lit(None).cast("int").alias("page"), F.lit("numbering").alias("problem"))
    return each.unionByName(gaps)


def document_links(df: DataFrame, key: str, html: str, host: str) -> DataFrame:
    """title, url, format of the links to documents (pdf, doc, docx, zip), absolute; of links to one URL the first one by key and place (SRC-07)."""
    pattern = r'(?is)<a\s+[^>]*href="([^"]+\.(?:pdf|docx?|zip))"[^>]*>.*?<div\s+class="t">(.*?)</div>.*?</a>'
    href, title = (F.regexp_extract_all(html, F.lit(pattern), F.lit(i)) for i in (1, 2))
    each = df.select(key, F.posexplode(F.arrays_zip(href.alias("href"), title.alias("title"))).alias("__at", "x")).select(key, "__at", "x.href", "x.title")
    href = F.col("href")
    url = F.when(href.rlike("(?i)^[a-z][a-z0-9+.-]*:"), href).when(href.startswith("/"), F.concat(F.lit(host.rstrip("/")), href)).otherwise(F.concat(F.lit(host.rstrip("/") + "/"), href))
    clean = F.trim(F.regexp_replace(F.regexp_replace("title", "<[^>]+>", ""), r"\s+", " "))
    made = each.select(key, "__at", clean.alias("title"), url.alias("url"), F.lower(F.regexp_extract("href", r"\.([^.]+)$", 1)).alias("format"))
    first = made.groupBy("url").agg(F.min_by(F.struct("title", "format"), F.struct(key, "__at")).alias("x"))
    return first.select("x.title", "url", "x.format")


def page_count(html: Column) -> Column:
    """The number of pages that a pager's attribute states, in either order of attributes; 1 without one (SRC-08)."""
    found = [F.regexp_extract(html, p, 1) for p in (r'id="btn_new"[^>]*data-max="(\d+)"', r'data-max="(\d+)"[^>]*id="btn_new"')]
    return F.coalesce(*[F.when(x != "", x.cast("long")) for x in found], F.lit(1).cast("long"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An event log of one JSON object a line. A line that does not parse is an error that names its file and number (SRC-16). Blank lines are no events."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter("trim(value) <> ''")
    parsed = lines.select("file", "value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    bad = parsed.filter("x IS NULL OR x._bad IS NOT NULL").select("file", "value").limit(1).collect()
    if bad:
        whole = spark.read.text(bad[0]["file"], wholetext=True).select(F.posexplode(F.split("value", "\n", -1)).alias("i", "line"))
        at = whole.filter(F.col("line") == bad[0]["value"]).agg(F.min("i")).first()[0]
        raise ValueError(f"{bad[0]['file']}, line {at + 1}: not an event")
    return parsed.select("x.*").drop("_bad")


# --- probes (SRC-19): text columns to typed structs; a malformed probe is an error --------------------


def _must(good: Column, value: Column, what: str) -> Column:
    return F.when(good, value).otherwise(F.raise_error(F.lit(what)))


def _whole(c: Column, what: str, least: int | None = None) -> Column:
    n = F.try_to_number(c, F.lit("S999999999999999")).cast("long")
    return _must(c.rlike("^-?[0-9]{1,15}$") & (F.lit(True) if least is None else n >= least), n, what)


def systemd_show(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x != "")
    m = F.map_from_entries(F.transform(lines, lambda x: F.struct(F.substring_index(x, "=", 1), F.substr(x, F.instr(x, "=") + 1))))
    fields = ("LoadState", "ActiveState", "SubState", "NRestarts", "ExecMainStatus", "MainPID", "Result")
    sound = F.forall(lines, lambda x: F.instr(x, "=") > 1) & F.forall(F.array(*map(F.lit, fields)), lambda k: F.map_contains_key(m, k)) & (m["LoadState"] == "loaded")
    ok = lambda c: _must(F.coalesce(sound, F.lit(False)), c, "systemd status is malformed")
    return F.struct(
        ok(m["ActiveState"]).alias("active_state"), ok(m["SubState"]).alias("sub_state"), _whole(ok(m["NRestarts"]), "NRestarts", 0).alias("n_restarts"),
        _whole(ok(m["ExecMainStatus"]), "ExecMainStatus").alias("exec_main_status"), _whole(ok(m["MainPID"]), "MainPID", 0).alias("main_pid"), ok(m["Result"]).alias("result"),
    )


def meminfo(text: Column) -> Column:
    """Bytes that are available."""
    kb = F.regexp_extract(text, r"(?m)^MemAvailable:\s+(\d+)\s+kB$", 1)
    return _must(kb != "", kb.cast("long") * 1024, "MemAvailable is missing")


def gpu_table(text: Column) -> Column:
    """Lines of temperature, use, memory used and memory in all."""
    rows = F.transform(F.filter(F.split(F.trim(text), "\n", -1), lambda x: x != ""), lambda x: F.transform(F.split(x, ",", -1), lambda v: F.try_to_number(F.trim(v), F.lit("S999999999999999.999")).cast("double")))
    good = (F.size(rows) > 0) & F.forall(rows, lambda r: (F.size(r) == 4) & F.forall(r, lambda v: v.isNotNull()))
    total = lambda i: F.aggregate(rows, F.lit(0.0), lambda a, r: a + r[i])
    s = F.struct(F.size(rows).alias("devices"), F.array_max(F.transform(rows, lambda r: r[0])).alias("max_temperature_c"), F.array_max(F.transform(rows, lambda r: r[1])).alias("max_utilization_percent"), total(2).alias("memory_used_mib"), total(3).alias("memory_total_mib"))
    return _must(good, s, "the table of devices is malformed")


def throttle_reasons(text: Column) -> Column:
    """The reasons, or null without any."""
    found = F.transform(F.filter(F.split(F.trim(text), "\n", -1), lambda x: x != ""), F.trim)
    return F.when(F.size(found) > 0, _must(F.forall(found, lambda x: x.rlike("^[A-Za-z0-9 .:_-]{1,64}$")), found, "throttle reasons are malformed"))


def sensors(text: Column) -> Column:
    """Readings of processor and board chips, and the hottest of them; text: chip -> feature -> reading name -> number."""
    chips = F.from_json(text, "map<string, map<string, string>>")
    taken = F.map_filter(chips, lambda k, v: k.rlike("(?i)coretemp|k10temp|zenpower|cpu[-_]?thermal|x86_pkg_temp|acpitz"))
    features = F.flatten(F.transform(F.map_values(taken), lambda m: F.map_values(m)))
    # a feature that is no object (the adapter's name) parses to null
    each = F.flatten(F.transform(features, lambda f: F.coalesce(F.map_values(F.map_filter(F.from_json(f, "map<string, double>"), lambda k, v: k.rlike(r"^temp\d+_input$") & v.isNotNull())), F.array().cast("array<double>"))))
    return _must(F.coalesce(F.size(each) > 0, F.lit(False)), F.struct(F.size(each).alias("readings"), F.array_max(each).alias("max_temperature_c")), "no processor or board temperature")
