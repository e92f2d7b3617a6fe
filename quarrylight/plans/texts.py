"""Scalar functions, search, sources and gates over the text tables. Query names begin with the operators' ids."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylight import functions as X
from quarrylight import operators as O
from quarrylight.operators import search as S
from quarrylight.session import ship
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


def docs(s, d, *cols):
    return T(s, d, "documents").select(*(cols or ("doc_id", "text")))


def lines(s, d):
    return docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"

# --- sources -------------------------------------------------------------------------------------


@q("SELECT event_id, json_extract_string(props, '$.page') AS page FROM events")
def src01_strict_json(s, d):
    """A declared schema; unknown text fails instead of becoming null columns."""
    return T(s, d, "events").select("event_id", F.from_json("props", "page string", {"mode": "FAILFAST"})["page"].alias("page"))


@q("SELECT 0::BIGINT AS n")
def src02_optional(s, d):
    from quarrylight.sources import read_optional

    return read_optional(s, f"{d}/no_such_table.parquet", "id long").agg(n().alias("n"))


@q(f"WITH {_LINES} SELECT doc_id, i + 1 AS page, length(line) AS chars FROM l")
def src03_paged_text(s, d):
    from quarrylight.sources import pages

    return pages(docs(s, d), "doc_id", "text", separator="\n").select("doc_id", "page", F.length("body").cast("long").alias("chars"))


@q()
def src09_html_to_text(s, d):
    return T(s, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@q("SELECT sha256(text) AS sha, count(*) AS copies, bool_or(n_chars < 200) AS needs_ocr FROM documents GROUP BY 1 HAVING count(*) > 1")
def src12_inventory(s, d):
    p = docs(s, d, "text", "n_chars").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha"), X.needs_ocr(F.col("n_chars"), F.lit(1)).alias("o"))
    return p.groupBy("sha").agg(n().alias("copies"), F.bool_or("o").alias("needs_ocr")).filter("copies > 1")


@q("SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_acctbal > 100.0")
def src14_prepared_statement(s, d):
    return s.sql("SELECT c_custkey FROM {customer} WHERE c_nationkey = :nation AND c_acctbal > :least", args={"nation": 3, "least": 100.0}, customer=T(s, d, "customer"))


@q("SELECT 'spec-' || lpad(i::VARCHAR, 3, '0') AS id, CASE WHEN i = 2 THEN 'local' ELSE 'remote' END AS origin FROM (SELECT unnest(range(1, 6)) AS i)")
def src20_static_specs(s, d):
    specs = s.range(1, 6).select(F.concat(F.lit("spec-"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("id"))
    local = s.createDataFrame([("spec-002", "local")], "id string, o string")
    return specs.join(local, "id", "left").select("id", F.coalesce("o", F.lit("remote")).alias("origin"))


# --- scalar functions ----------------------------------------------------------------------------


@q("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' ?\\r?\\n ?', ' ', 'g'), ' ') AS block FROM documents")
def sca01_normalize_block(s, d):
    return docs(s, d).select("doc_id", X.normalize_block(F.col("text")).alias("block"))


@q("SELECT doc_id, len(regexp_split_to_array(text, '\\n\\s*\\n')) AS paragraphs FROM documents")
def sca02_paragraphs(s, d):
    return docs(s, d).select("doc_id", F.size(X.blocks(F.col("text"))).cast("long").alias("paragraphs"))


@q("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]')) AS meaningful, len(regexp_extract_all(text, '[\\p{L}\\p{N}]')) AS letters FROM documents")
def sca03_meaningful(s, d):
    t = F.col("text")
    return docs(s, d).select("doc_id", X.meaningful_characters(t).cast("long").alias("meaningful"), X.meaningful_characters(t, r"[\p{L}\p{N}]").cast("long").alias("letters"))


@q("SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS chars FROM documents")
def sca04_dense_length(s, d):
    return docs(s, d).select("doc_id", X.dense_length(F.col("text")).cast("long").alias("chars"))


@q("SELECT doc_id, ((length(text) - length(replace(text, 'tion', ''))) / 4)::BIGINT AS n, 0::BIGINT AS empty FROM documents")
def sca05_exact_count(s, d):
    return docs(s, d).select("doc_id", X.exact_count(F.col("text"), "tion").cast("long").alias("n"), X.exact_count(F.col("text"), "").cast("long").alias("empty"))


@q("SELECT doc_id, CASE WHEN contains(text, 'tion') THEN instr(text, 'tion') - 1 END AS first, ((length(text) - length(replace(text, 'tion', ''))) / 4)::BIGINT AS n FROM documents")
def sca06_offsets(s, d):
    at = X.occurrence_starts(F.col("text"), "tion")
    return docs(s, d).select("doc_id", F.when(F.size(at) > 0, at[0]).cast("long").alias("first"), F.size(at).cast("long").alias("n"))


@q("""SELECT doc_id, (CASE WHEN greatest(0, instr(text, 'tion') - 73) > 0 THEN '…' ELSE '' END) || substring(text, greatest(0, instr(text, 'tion') - 73) + 1, least(length(text), instr(text, 'tion') + 171) - greatest(0, instr(text, 'tion') - 73)) || (CASE WHEN least(length(text), instr(text, 'tion') + 171) < length(text) THEN '…' ELSE '' END) AS excerpt FROM documents WHERE contains(text, 'tion')""")
def sca07_excerpt(s, d):
    at = F.instr("text", "tion") - 1
    return docs(s, d).filter(F.contains("text", F.lit("tion"))).select("doc_id", X.excerpt(F.col("text"), at, F.lit(4)).alias("excerpt"))


@q("SELECT o_orderkey, year(o_orderdate) AS first_year FROM orders")
def sca08_years(s, d):
    return T(s, d, "orders").select("o_orderkey", X.first_year(F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd"))).cast("long").alias("first_year"))


@q("SELECT doc_id, coalesce(quality, toxic, 0)::INT AS value, CASE WHEN quality IS NOT NULL THEN 'quality' WHEN toxic IS NOT NULL THEN 'toxic' ELSE 'unknown' END AS basis FROM documents LEFT JOIN labels USING (doc_id)")
def sca10_prioritized(s, d):
    v, b = X.prioritized(("quality", F.col("quality")), ("toxic", F.col("toxic")))
    return docs(s, d, "doc_id").join(T(s, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce(v, F.lit(0)).alias("value"), b.alias("basis"))


@q("SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'STEEL') THEN 'steel' WHEN regexp_matches(p_type, 'BRASS|COPPER') THEN 'alloy' ELSE 'other' END AS class FROM part")
def sca11_keyword_class(s, d):
    return T(s, d, "part").select("p_partkey", X.classify(F.col("p_type"), [("STEEL", "steel"), ("BRASS|COPPER", "alloy")], "other").alias("class"))


@q("SELECT c_custkey, regexp_replace(c_name, '[#_]+', ' ', 'g') AS title FROM customer")
def sca12_title(s, d):
    return T(s, d, "customer").select("c_custkey", F.regexp_replace("c_name", "[#_]+", " ").alias("title"))


@q("SELECT p_partkey, regexp_extract(p_name, '^(\\S+)', 1) AS head, regexp_extract(p_brand, '([0-9]+)$', 1) AS page FROM part")
def sca13_line_parse(s, d):
    return T(s, d, "part").select("p_partkey", F.regexp_extract("p_name", r"^(\S+)", 1).alias("head"), F.regexp_extract("p_brand", r"([0-9]+)$", 1).alias("page"))


@q()
def sca15_canonical(s, d):
    ship(s)
    return docs(s, d).select("doc_id", F.sha2(X.canonical_ocr(F.col("text")).cast("binary"), 256).alias("canonical"))


@q("SELECT doc_id, array_to_string(regexp_extract_all(text, '([0-9]+(?:\\.[0-9]+)?)', 1), ',') AS numbers FROM documents")
def sca16_numbers(s, d):
    return docs(s, d).select("doc_id", F.array_join(X.numbers_in(F.col("text")), ",").alias("numbers"))


@q("SELECT a.p_partkey, round(1 - levenshtein(a.p_name, b.p_name) / greatest(1, length(a.p_name), length(b.p_name)), 4) AS agreement FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def sca17_agreement(s, d):
    p = T(s, d, "part")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(b, "p_partkey").select("p_partkey", X.agreement(F.col("p_name"), F.col("other")).alias("agreement"))


@q()
def sca18_dice(s, d):
    p = T(s, d, "part")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(b, "p_partkey").select("p_partkey", X.dice(F.col("p_name"), F.col("other")).alias("dice"))


@q("SELECT doc_id, regexp_replace(text, '\\s+[0-9]+\\s*$', '') AS body FROM documents")
def sca19_trailing_number(s, d):
    return docs(s, d).select("doc_id", F.regexp_replace("text", r"\s+[0-9]+\s*\z", "").alias("body"))


@q("SELECT doc_id, sha256(text) AS sha, substr(sha256(doc_id || '|' || lang), 1, 24) AS id FROM documents")
def sca20_hashes(s, d):
    return docs(s, d, "doc_id", "text", "lang").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), X.compact_id(F.col("doc_id").cast("string"), F.col("lang")).alias("id"))


@q("""SELECT c_custkey, '{"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}' AS json FROM customer""")
def sca21_stable_json(s, d):
    return T(s, d, "customer").select("c_custkey", X.stable_json("c_name", "c_mktsegment").alias("json"))


@q()
def sca22_fnv1a(s, d):
    return T(s, d, "customer").select("c_custkey", X.fnv1a(F.col("c_name")).alias("hash"))


@q("SELECT p_partkey, round(CASE WHEN p_size <= 0 THEN 0.0 WHEN p_size <= 10 THEN p_size / 10.0 WHEN p_size <= 50 THEN 1 + (p_size - 10) / 20.0 ELSE 3.0 END, 6) AS y FROM part")
def sca23_interpolate(s, d):
    return T(s, d, "part").select("p_partkey", F.round(X.interpolate(F.col("p_size"), [(0, 0.0), (10, 1.0), (50, 3.0)]), 6).alias("y"))


@q("""WITH v AS (SELECT vec_id, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS z FROM embeddings),
r AS (SELECT vec_id, x * cos(0.5) - z * sin(0.5) AS x1, x * sin(0.5) + z * cos(0.5) AS z1, y FROM v), t AS (SELECT vec_id, x1, y * cos(0.2) - z1 * sin(0.2) AS y1, y * sin(0.2) + z1 * cos(0.2) AS z2 FROM r)
SELECT vec_id, round(x1 * 930 / greatest(360, 930 + z2), 4) AS sx, round(y1 * 930 / greatest(360, 930 + z2), 4) AS sy FROM t""")
def sca24_projection(s, d):
    v = T(s, d, "embeddings").select("vec_id", *[(F.col("embedding")[i].cast("double") * 100).alias(c) for i, c in enumerate("xyz")])
    x, y, _ = X.project(F.col("x"), F.col("y"), F.col("z"), 0.5, 0.2)
    return v.select("vec_id", F.round(x, 4).alias("sx"), F.round(y, 4).alias("sy"))


@q("SELECT p_partkey, round(least(1.0, 0.2 + 0.1 * log2(p_size + 1)), 4) AS strength FROM part")
def sca25_strengths(s, d):
    return T(s, d, "part").select("p_partkey", X.log_strength(F.col("p_size"), 0.2, 0.1, 1.0).alias("strength"))


@q("SELECT event_id, (floor(epoch(ts) / 3600) * 3600)::BIGINT AS w FROM events")
def sca26_window_start(s, d):
    return T(s, d, "events").select("event_id", X.window_start(F.col("ts").cast("timestamp"), 3600).alias("w"))


@q("SELECT event_id, (epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)))::DOUBLE AS age FROM events")
def sca27_age(s, d):
    return T(s, d, "events").select("event_id", X.age_seconds(F.lit("2024-02-01 00:00:00").cast("timestamp"), F.col("ts").cast("timestamp")).alias("age"))


@q("SELECT p_partkey, lpad(p_partkey::VARCHAR, 8, '0') AS padded, concat_ws('/', p_brand, p_type) AS path FROM part")
def sca28_padding(s, d):
    return T(s, d, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("padded"), F.concat_ws("/", "p_brand", "p_type").alias("path"))


@q("SELECT event_id, json_valid(props) AS ok, coalesce(nullif(trim(event_type), ''), 'none') AS kind FROM events")
def sca29_sql_scalars(s, d):
    return T(s, d, "events").select("event_id", F.try_parse_json("props").isNotNull().alias("ok"), F.coalesce(F.nullif(F.trim("event_type"), F.lit("")), F.lit("none")).alias("kind"))


@q("SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS local FROM events")
def sca30_time_zone(s, d):
    return T(s, d, "events").select("event_id", F.date_format(F.col("ts") + F.expr("INTERVAL 8 HOURS"), "yyyy-MM-dd HH:mm").alias("local"))


@q("SELECT doc_id, n_chars <= 512 AS scan, n_chars < 200 AS ocr FROM documents")
def sca31_scan_density(s, d):
    c = F.col("n_chars")
    return docs(s, d, "doc_id", "n_chars").select("doc_id", X.is_scan(c, F.lit(1)).alias("scan"), X.needs_ocr(c, F.lit(1)).alias("ocr"))


# --- search --------------------------------------------------------------------------------------

QUERY = "nation theheating"


@q("""SELECT unnest(['nation', 'theh', 'hehe', 'ehea', 'heat', 'eati', 'atin', 'ting']) AS phrase, unnest(range(0, 8)) AS i""")
def fts01_planner(s, d):
    return s.createDataFrame([(p, i) for i, p in enumerate(S.phrases(QUERY))], "phrase string, i long")


_BM = "'nation', 'heat', 'tion'"


def _bm_sql(tail: str) -> str:
    terms = ["nation", "heat"]
    tf = [f"len(regexp_extract_all(lower(text), '{t}'))" for t in terms]
    cols = ", ".join(f"{x} AS f{i}" for i, x in enumerate(tf))
    st = ", ".join(f"sum((f{i} > 0)::INT) AS n{i}" for i in range(len(terms)))
    score = " ".join(f"- greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    hit = " OR ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"""WITH t AS (SELECT doc_id, lang, source, greatest(length(text) - 2, 0) AS dl, {cols} FROM documents), s AS (SELECT count(*) AS n, avg(dl) AS avgdl, {st} FROM t),
r AS (SELECT doc_id, lang, source, 0.0 {score} AS score FROM t, s WHERE {hit}) {tail}"""


def index(s, d):
    """The trigram index of the documents, built once an application."""
    return S.Index.of(docs(s, d), "doc_id", ["text"], f"{d}/documents")


@q("SELECT doc_id FROM documents WHERE contains(lower(text), 'nation') OR contains(lower(text), 'heat')")
def fts02_phrase_match(s, d):
    """By posting lists, verified on the texts of the candidates."""
    return index(s, d).bm25(docs(s, d), "nation heat is").select("doc_id")


@q("SELECT doc_id FROM documents WHERE contains(lower(text), 'tionment') AND len(regexp_extract_all(lower(text), 'tionment')) > 0")
def src15_index_scan(s, d):
    """A phrase of eight characters as its 4-grams, any of which matches, then the phrase as a whole."""
    hits = index(s, d).bm25(docs(s, d), "tionment").select("doc_id")
    return docs(s, d).join(hits, "doc_id", "left_semi").filter(F.contains(F.lower("text"), F.lit("tionment"))).select("doc_id")


@q(_bm_sql("SELECT doc_id, round(score, 6) AS score FROM r"))
def fts03_bm25(s, d):
    return index(s, d).bm25(docs(s, d), "nation heat").select("doc_id", F.round("score", 6).alias("score"))


@q(_bm_sql("SELECT doc_id, round(score, 6) AS score FROM r WHERE lang = 'en' ORDER BY r.score, doc_id LIMIT 12"))
def fts04_top(s, d):
    return S.retrieve(docs(s, d, "doc_id", "text", "lang"), "nation heat", ["text"], "doc_id", limit=20, gate=F.col("lang") == "en", index=index(s, d)).select("doc_id", F.round("score", 6).alias("score"))


@q("SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'es') ORDER BY doc_id LIMIT 12")
def fts05_fallback(s, d):
    return S.retrieve(docs(s, d), "es", ["text"], "doc_id", index=index(s, d)).select("doc_id", "score")


@q(_bm_sql("SELECT doc_id, source, round(score, 6) AS score FROM r WHERE source IN ('src1', 'src11') ORDER BY r.score, source, doc_id LIMIT 30"))
def fts06_facet_fan_out(s, d):
    hits = index(s, d).bm25(docs(s, d, "doc_id", "text", "source"), "nation heat").filter(F.col("source").isin("src1", "src11"))
    return hits.orderBy("score", "source", "doc_id").limit(30).select("doc_id", "source", F.round("score", 6).alias("score"))


@q("""SELECT doc_id, substring(text, greatest(1, instr(lower(text), 'heat') - 80), instr(lower(text), 'heat') - greatest(1, instr(lower(text), 'heat') - 80) + 4 + 140) AS snippet FROM documents WHERE contains(lower(text), 'heat') ORDER BY doc_id LIMIT 20""")
def fts08_snippets(s, d):
    t = docs(s, d).withColumn("snippet", S.snippet(F.col("text"), "heat")).filter("snippet IS NOT NULL")
    return t.orderBy("doc_id").limit(20).select("doc_id", "snippet")


@q("SELECT string_agg('[P:' || item_id || '] ' || substring(text, 1, 40), chr(10) ORDER BY item_id) AS context FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT 10)")
def fts09_context(s, d):
    top = T(s, d, "benchmark").orderBy("item_id").limit(10)
    rows = F.sort_array(F.collect_list(F.struct("item_id", "text")))
    part = F.transform(rows, lambda r: F.concat(F.lit("[P:"), r["item_id"].cast("string"), F.lit("] "), F.substring(r["text"], 1, 40)))
    return top.agg(F.array_join(part, "\n").alias("context"))


@q()
def fts10_citations(s, d):
    ship(s)
    a = T(s, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.concat("text", F.lit(" [P:"), F.col("turn").cast("string"), F.lit("]")).alias("text"))
    r = a.select("conv_id", "turn", S.citations_udf()(F.col("text"), F.array(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("c"))
    return r.select("conv_id", "turn", "c.valid", F.size("c.invalid").alias("invalid"), F.size("c.uncited").alias("uncited"))


@q("SELECT c.conv_id, c.turn, b.item_id, substring(b.text, 1, 240) AS excerpt FROM conversations c JOIN benchmark b ON b.item_id = c.turn WHERE c.role = 'assistant'")
def fts11_citation_projection(s, d):
    c = T(s, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn")
    return c.join(T(s, d, "benchmark"), F.col("item_id") == F.col("turn")).select("conv_id", "turn", "item_id", F.substring("text", 1, 240).alias("excerpt"))


# --- gates ---------------------------------------------------------------------------------------


@q("""SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) <> max(turn) - min(turn) + 1 OR count(DISTINCT turn) <> count(*)""")
def gat01_page_contiguity(s, d):
    return T(s, d, "conversations").groupBy("conv_id").agg(n().alias("c"), F.min("turn").alias("a"), F.max("turn").alias("b"), F.count_distinct("turn").alias("u")).filter("c <> b - a + 1 OR u <> c").select("conv_id")


@q("""SELECT doc_id, array_to_string(list_filter([CASE WHEN canonical <> doc_id THEN 'alias' END, CASE WHEN n_chars < 100 THEN 'too_few_characters' END, CASE WHEN regexp_matches(text, '[äöüß]') THEN 'forbidden_script' END,
CASE WHEN NOT regexp_matches(text, '[aeiou]') THEN 'missing_script' END], lambda x: x IS NOT NULL), ',') AS reasons FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents)""")
def gat02_disposition(s, d):
    w = Window.partitionBy(F.sha2(F.col("text").cast("binary"), 256))
    t = docs(s, d, "doc_id", "text", "n_chars").withColumn("canonical", F.min("doc_id").over(w))
    r = O.reasons(alias=F.col("canonical") != F.col("doc_id"), too_few_characters=F.col("n_chars") < 100, forbidden_script=F.col("text").rlike("[äöüß]"), missing_script=~F.col("text").rlike("[aeiou]"))
    return t.select("doc_id", F.array_join(r, ",").alias("reasons"))


@q("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars < 200)")
def gat03_publication_gate(s, d):
    t = docs(s, d, "doc_id", "n_chars")
    ok = T(s, d, "labels").filter("quality = 1 AND toxic = 0")
    return t.join(ok, "doc_id", "left_semi").join(t.filter("n_chars < 200"), "doc_id", "left_anti").select("doc_id")


@q("SELECT doc_id, CASE WHEN quality = 1 THEN 'accepted' ELSE 'candidate' END AS class FROM documents LEFT JOIN labels USING (doc_id)")
def gat04_observation_class(s, d):
    return docs(s, d, "doc_id").join(T(s, d, "labels"), "doc_id", "left").select("doc_id", F.when(F.col("quality") == 1, "accepted").otherwise("candidate").alias("class"))


@q("""WITH x AS (SELECT a.p_partkey, 1 - levenshtein(a.p_name, b.p_name) / greatest(1, length(a.p_name), length(b.p_name)) AS g, a.p_brand = b.p_brand AS title, a.p_size = b.p_size AS numbers, a.p_name = '' AS blank FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, CASE WHEN blank THEN 'blank' WHEN g >= 0.995 AND title AND numbers THEN 'pass' WHEN g >= 0.985 AND title THEN 'manual' ELSE 'closed' END AS gate FROM x""")
def gat05_witness_gate(s, d):
    p = T(s, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("n2"), F.col("p_brand").alias("b2"), F.col("p_size").alias("s2"))
    g = 1 - F.levenshtein("p_name", "n2") / F.greatest(F.lit(1), F.length("p_name"), F.length("n2"))
    title, same = F.col("p_brand") == F.col("b2"), F.col("p_size") == F.col("s2")
    gate = F.when(F.col("p_name") == "", "blank").when((g >= 0.995) & title & same, "pass").when((g >= 0.985) & title, "manual").otherwise("closed")
    return p.join(b, "p_partkey").select("p_partkey", gate.alias("gate"))


@q("""SELECT doc_id, CASE WHEN toxic = 1 THEN 1 WHEN quality = 0 THEN 2 WHEN quality IS NULL THEN 3 ELSE 9 END AS priority FROM documents LEFT JOIN labels USING (doc_id)""")
def gat07_review_priority(s, d):
    p = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 2).when(F.col("quality").isNull(), 3).otherwise(9)
    return docs(s, d, "doc_id").join(T(s, d, "labels"), "doc_id", "left").select("doc_id", p.alias("priority"))


@q("SELECT CASE WHEN n_chars < 100 THEN 'blank' WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'regular' ELSE 'long' END AS category, count(*) AS n FROM documents GROUP BY 1")
def gat08_triage(s, d):
    c = F.col("n_chars")
    cat = F.when(c < 100, "blank").when(c < 1000, "short").when(c < 5000, "regular").otherwise("long")
    return docs(s, d, "n_chars").groupBy(cat.alias("category")).agg(n().alias("n"))


@q("""SELECT doc_id, CASE WHEN contains(text, '�') THEN 'damaged' WHEN m > 1 THEN 'verified' ELSE 'single' END AS lane FROM (SELECT *, count(*) OVER (PARTITION BY text) AS m FROM documents)""")
def gat09_verification_lanes(s, d):
    w = Window.partitionBy(F.sha2(F.col("text").cast("binary"), 256))
    lane = F.when(F.contains("text", F.lit("�")), "damaged").when(n().over(w) > 1, "verified").otherwise("single")
    return docs(s, d).select("doc_id", lane.alias("lane"))


@q("""SELECT 'unique_documents' AS "check", count(*) - count(DISTINCT doc_id) AS violations, count(*) = count(DISTINCT doc_id) AS passed FROM documents
UNION ALL SELECT 'labels_refer', count(*), count(*) = 0 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'lines_have_orders', count(*), count(*) = 0 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orders_have_lines', count(*), count(*) = 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def gat11_check_frame(s, d):
    dd, o, li = docs(s, d, "doc_id"), T(s, d, "orders"), T(s, d, "lineitem")
    return O.checks(
        ("unique_documents", dd.groupBy("doc_id").count().filter("count > 1")),
        ("labels_refer", T(s, d, "labels").join(dd, "doc_id", "left_anti")),
        ("lines_have_orders", li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")),
        ("orders_have_lines", o.join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")),
    )


@q("""SELECT n_name, s.m AS segment FROM nation, (SELECT DISTINCT c_mktsegment AS m FROM customer) s WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = s.m)""")
def gat13_completeness_matrix(s, d):
    """Two fixed dimensions make the cells; those without a customer are listed."""
    c = T(s, d, "customer")
    cells = T(s, d, "nation").select("n_nationkey", "n_name").crossJoin(c.select(F.col("c_mktsegment").alias("segment")).distinct())
    have = c.select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("segment"))
    return cells.join(have, ["n_nationkey", "segment"], "left_anti").select("n_name", "segment")


@q("SELECT event_id, list_filter([CASE WHEN value IS NULL THEN 'value' END, CASE WHEN value < 0 THEN 'range' END, CASE WHEN NOT event_type IN ('click', 'view', 'purchase', 'login', 'logout', 'signup', 'search') THEN 'enum' END], lambda x: x IS NOT NULL)::VARCHAR = '[]' AS valid FROM events")
def gat15_record_schema(s, d):
    r = O.reasons(value=F.col("value").isNull(), range=F.col("value") < 0, enum=~F.col("event_type").isin("click", "view", "purchase", "login", "logout", "signup", "search"))
    return T(s, d, "events").select("event_id", (F.size(r) == 0).alias("valid"))


@q("SELECT l_orderkey, count(DISTINCT l_suppkey) >= 2 AND count(*) >= 2 AS verified FROM lineitem GROUP BY 1")
def gat16_verification_rules(s, d):
    g = T(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_suppkey", "l_linenumber")).alias("e"))
    return g.select("l_orderkey", ((F.size(F.array_distinct(F.transform("e", lambda x: x["l_suppkey"]))) >= 2) & (F.size("e") >= 2)).alias("verified"))


@q("SELECT 'documents' AS metric, count(*) AS observed, 100000::BIGINT AS budget, count(*) <= 100000 AS within FROM documents UNION ALL SELECT 'chars', sum(n_chars)::BIGINT, 1000::BIGINT, sum(n_chars) <= 1000 FROM documents")
def gat17_budget(s, d):
    o = docs(s, d, "n_chars").agg(n().alias("documents"), F.sum("n_chars").alias("chars")).unpivot([], ["documents", "chars"], "metric", "observed")
    b = s.createDataFrame([("documents", 100000), ("chars", 1000)], "metric string, budget long")
    return o.join(b, "metric").select("metric", "observed", "budget", (F.col("observed") <= F.col("budget")).alias("within"))


@q("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IS DISTINCT FROM (CASE WHEN c_custkey % 50 = 0 THEN -1 ELSE c_nationkey END)")
def gat20_identity_guard(s, d):
    old = T(s, d, "customer").select("c_custkey", "c_nationkey")
    new = old.select("c_custkey", F.when(F.col("c_custkey") % 50 == 0, -1).otherwise(F.col("c_nationkey")).alias("now"))
    drift = old.join(new, "c_custkey").filter(~F.col("c_nationkey").eqNullSafe(F.col("now")))
    return T(s, d, "orders").join(drift, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@q("""WITH i AS (SELECT doc_id, unnest(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN lang = 'de' THEN 'german' END], lambda x: x IS NOT NULL)) AS code FROM documents),
r AS (SELECT code, doc_id, doc_id - row_number() OVER (PARTITION BY code ORDER BY doc_id) AS k FROM i) SELECT code, min(doc_id) AS first, max(doc_id) AS last, count(*) AS length FROM r GROUP BY code, k""")
def gat22_issue_ranges(s, d):
    i = docs(s, d, "doc_id", "n_chars", "lang").select("doc_id", F.explode(O.reasons(short=F.col("n_chars") < 200, german=F.col("lang") == "de")).alias("code"))
    return O.islands(i, "code", "doc_id").select("code", "first", "last", "length")


@q("SELECT count(*) AS before, count(*) FILTER (WHERE n_chars >= 200) AS after, round(avg(n_chars) FILTER (WHERE n_chars >= 200) - avg(n_chars), 4) AS delta FROM documents")
def gat23_impact_preview(s, d):
    c = F.col("n_chars")
    return docs(s, d, "n_chars").agg(n().alias("before"), F.count_if(c >= 200).alias("after"), F.round(F.avg(F.when(c >= 200, c)) - F.avg(c), 4).alias("delta"))


@q("""SELECT d.doc_id, 'chars' AS issue FROM documents d WHERE n_chars <> length(text) UNION ALL SELECT doc_id, 'missing' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def gat27_inventory(s, d):
    t = docs(s, d, "doc_id", "text", "n_chars")
    a = t.filter(F.col("n_chars") != F.length("text")).select("doc_id", F.lit("chars").alias("issue"))
    return a.unionAll(T(s, d, "labels").join(t, "doc_id", "left_anti").select("doc_id", F.lit("missing").alias("issue")))
