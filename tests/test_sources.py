"""Readers, probes, releases and receipts on damaged input."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarrylight import operators as O
from quarrylight import release, sources
from quarrylight import streaming as R


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


SHOW = "LoadState=loaded\nActiveState=active\nSubState=running\nNRestarts=2\nExecMainStatus=-1\nMainPID=7\nResult=success\n"


@pytest.mark.parametrize(
    "parse,text",
    [
        (sources.systemd_show, SHOW.replace("loaded", "not-found")), (sources.systemd_show, SHOW.replace("NRestarts=2", "NRestarts=-2")), (sources.systemd_show, SHOW.replace("MainPID=7\n", "")),
        (sources.systemd_show, SHOW + "=x\n"), (sources.systemd_show, SHOW.replace("MainPID=7", "MainPID=7.5")),
        (sources.meminfo, "MemTotal: 5 kB"), (sources.meminfo, "MemAvailable: x kB"),
        (sources.gpu_table, ""), (sources.gpu_table, "1, 2, 3"), (sources.gpu_table, "1, 2, 3, N/A"),
        (sources.throttle_reasons, "a;b"), (sources.throttle_reasons, "x" * 65),
        (sources.sensors, '{"nvme": {"Composite": {"temp1_input": 3}}}'), (sources.sensors, "[]"), (sources.sensors, "no json"),
    ],
)
def test_malformed_probes(spark, parse, text):
    with pytest.raises(PySparkException):
        one(spark, parse, text)


def test_probes(spark):
    assert one(spark, sources.systemd_show, SHOW).asDict() == {"active_state": "active", "sub_state": "running", "n_restarts": 2, "exec_main_status": -1, "main_pid": 7, "result": "success"}
    assert one(spark, sources.meminfo, "A: 1 kB\nMemAvailable:  12 kB\n") == 12288
    assert one(spark, sources.gpu_table, "41, 9, 100, 6000\n55, 3, 50, 6000\n").asDict() == {"devices": 2, "max_temperature_c": 55.0, "max_utilization_percent": 9.0, "memory_used_mib": 150.0, "memory_total_mib": 12000.0}
    assert one(spark, sources.throttle_reasons, " \n") is None and one(spark, sources.throttle_reasons, "Not Active\nIdle\n") == ["Not Active", "Idle"]


def test_log_names_the_bad_line(spark, tmp_path):
    (tmp_path / "a.log").write_text('{"task": "x", "at": "2"}\n\n{"task": "y", "at": "1"}\n')
    assert sorted(r["task"] for r in sources.read_log(spark, f"file://{tmp_path}", "task string, at string").collect()) == ["x", "y"]
    (tmp_path / "b.log").write_text('{"task": "x", "at": "2"}\n\n{"task": \n')
    with pytest.raises(ValueError, match=r"b\.log, line 3"):
        sources.read_log(spark, f"file://{tmp_path}", "task string, at string")


def test_paged_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\fsecond\n\f")
    assert [(r["page"], r["body"]) for r in sources.read_paged_text(spark, f"file://{tmp_path}").orderBy("page").collect()] == [(1, "one"), (2, "second\n"), (3, "")]


def test_page_tree(spark, tmp_path):
    for p in (1, 2, 4):
        (tmp_path / f"d/pages/{p}").mkdir(parents=True)
        (tmp_path / f"d/pages/{p}/x.md").write_text(str(p))
    found = sources.read_page_directory(spark, f"file://{tmp_path}").select("document", "page", "sha256")
    assert [tuple(r) for r in sources.bind_pages(found, found).collect()] == [("d", None, "numbering")]
    assert sources.bind_pages(found.filter("page < 3"), found.filter("page < 3")).count() == 0


def test_links(spark):
    html = '<a href="/a.pdf"><div class="t">One &amp; <i>two</i></div></a><a href="x.html"><div class="t">no</div></a><A class="k" HREF="b.DOC" id="z"><div class="t">\nB </div></A><a href="/a.pdf"><div class="t">again</div></a>'
    df = spark.createDataFrame([(1, html), (2, None), (0, "")], "page int, html string")
    assert sorted(tuple(r) for r in sources.document_links(df, "page", "html", "https://h").collect()) == [("B", "https://h/b.DOC", "doc"), ("One &amp; two", "https://h/a.pdf", "pdf")]


def test_releases(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    a, b = spark.range(3).withColumnRenamed("id", "k"), spark.range(5).withColumnRenamed("id", "k")
    with pytest.raises(FileNotFoundError):
        release.read_release(spark, root)
    release.publish(a, root, ["k"])
    release.publish(b, root, ["k"])
    assert release.read_release(spark, root).count() == 5
    assert sorted(p.name for p in (tmp_path / "r/pointers").glob("*.json")) == ["000000000001.json", "000000000002.json"]
    (tmp_path / "r/pointers/000000000003.json.abc.part").write_text("{half")  # a writer that died
    assert release.read_release(spark, root).count() == 5
    with pytest.raises(ValueError):
        release.publish(a.union(a), root, ["k"])
    assert release.read_release(spark, root).count() == 5


def test_receipts(spark, tmp_path):
    sink = R.Receipts(f"file://{tmp_path}/s", expected=2)
    with pytest.raises(FileNotFoundError):
        sink.read(spark)
    sink(spark.range(4), 0)
    sink(spark.range(9), 0)  # arrives again, with other rows: it was received
    assert sink.read(spark).count() == 4
    spark.range(7).write.parquet(f"file://{tmp_path}/s/chunks/chunk=1")  # a writer that died before its receipt
    assert sink.read(spark).count() == 4
    with pytest.raises(ValueError, match="without receipt"):
        sink.finalize(spark)
    sink(spark.range(2), 1)
    assert sink.finalize(spark).count() == 6
    spark.range(1).write.mode("append").parquet(f"file://{tmp_path}/s/chunks/chunk=1")
    with pytest.raises(ValueError, match="differs"):
        sink.read(spark)


def test_ordinals(spark):
    df = spark.range(1000).selectExpr("id % 7 AS a", "id AS b")
    got = [(r["a"], r["b"]) for r in O.ordinals(df, ["a", "b"], "place").orderBy("place").collect()]
    assert got == sorted(got) and [r["place"] for r in O.ordinals(df, ["a", "b"], "place").orderBy("place").collect()] == list(range(1, 1001))
    assert O.ordinals(df.limit(0), ["a"], "place").collect() == []


def test_long_chains_are_an_error_not_shorter(spark):
    chain = spark.range(40).selectExpr("id AS node", "CASE WHEN id > 0 THEN id - 1 END AS parent")
    assert O.closure(spark, chain, "node", "parent").agg(F.max("depth")).first()[0] == 39
    chain = spark.range(130).selectExpr("id AS node", "CASE WHEN id > 0 THEN id - 1 END AS parent")
    with pytest.raises(Exception, match="(?i)recursi"):
        O.closure(spark, chain, "node", "parent").collect()


def test_index_and_scan_agree(spark, sf):
    from quarrylight.operators import search as S

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").limit(150)
    extra = spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "", "en"), (10**6 + 2, "naNAtion at ion nationation", "en"), (10**6 + 3, "ab 漢字文 々〇", "zh")], docs.schema)
    docs = docs.union(extra)
    index = S.Index.build(docs, "doc_id", ["text", "lang"], buckets=4)
    for query in ("nation heat", "tionment", "en", "漢字文", "nothing-that-is-there zzzzqq", ""):
        want = sorted((r["doc_id"], round(r["score"], 9)) for r in S.bm25(docs, query, ["text", "lang"], "doc_id").collect())
        assert sorted((r["doc_id"], round(r["score"], 9)) for r in index.bm25(docs, query).collect()) == want
        one, two = (S.retrieve(docs, query, ["text", "lang"], "doc_id", index=x) for x in (None, index))
        assert [r["doc_id"] for r in one.orderBy("score", "doc_id").collect()] == [r["doc_id"] for r in two.orderBy("score", "doc_id").collect()]
    assert S.phrases("々〇 漢字") == ["々〇", "漢字"]
