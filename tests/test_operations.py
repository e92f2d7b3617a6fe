"""Archives, fetches, transactions, locks, schedules and records on damaged and odd input."""

import hashlib
import io
import os
import tarfile
import threading
import time
import zipfile
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
import zstandard
from pyspark.sql import functions as F

from quarrylight import release
from quarrylight.sources import remote
from quarrylight.streaming import jobs


def tar(files, mode="w", link=None):
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode=mode) as t:
        for name, body in files:
            x = tarfile.TarInfo(name)
            x.size = len(body)
            t.addfile(x, io.BytesIO(body))
        if link:
            x = tarfile.TarInfo(link)
            x.type, x.linkname = tarfile.SYMTYPE, "/etc/hostname"
            t.addfile(x)
    return b.getvalue()


def test_archives(spark, tmp_path):
    files = [("a/1.md", b"one"), ("a/empty", b""), ("b/2.bin", bytes(range(256)) * 1000)]
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as x:
        for name, body in files:
            x.writestr(name, body)
    made = {"t.tar": tar(files), "t.tar.gz": tar(files, "w:gz"), "t.tar.zst": zstandard.compress(tar(files)), "t.zip": z.getvalue(), "none.tar": tar([])}
    (tmp_path / "in").mkdir()
    for name, body in made.items():
        (tmp_path / "in" / name).write_bytes(body)
    text = "\n".join(f"{hashlib.sha256(b).hexdigest()}  {k}" for k, b in made.items())
    (tmp_path / "sums").write_text(text + "\n\n")
    sums = remote.read_sums(spark, str(tmp_path / "sums"))
    got = remote.read_archives(spark, str(tmp_path / "in"), sums).collect()
    assert sorted((r["archive"], r["member"], bytes(r["content"])) for r in got) == sorted((k, n, b) for k in made if k != "none.tar" for n, b in files)
    (tmp_path / "in" / "t.zip").write_bytes(b"changed")
    (tmp_path / "in" / "other.tar").write_bytes(b"x")
    os.remove(tmp_path / "in" / "t.tar")
    with pytest.raises(ValueError, match="other.tar unknown, t.tar missing, t.zip differs"):
        remote.read_archives(spark, str(tmp_path / "in"), sums)
    (tmp_path / "sums").write_text("no sum\n")
    with pytest.raises(Exception, match="not a line of sums"):
        remote.read_sums(spark, str(tmp_path / "sums")).collect()
    for bad in (tar([("../x", b"")]), tar([("/x", b"")]), tar([], link="l")):
        with pytest.raises(ValueError, match="unsafe member|link"):
            list(remote.members("x.tar", bad))


class Flaky(BaseHTTPRequestHandler):
    asked: dict = {}

    def do_GET(self):
        k = Flaky.asked[self.path] = Flaky.asked.get(self.path, 0) + 1
        good = self.path == "/good" or (self.path == "/third" and k >= 3)
        self.send_response(200 if good else 503)
        self.end_headers()
        if good:
            self.wfile.write(b"body of " + self.path.encode())

    def log_message(self, *args):
        pass


def test_fetch(spark, tmp_path):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Flaky)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    host, store = f"http://127.0.0.1:{server.server_port}", str(tmp_path / "store")
    urls = spark.createDataFrame([(f"{host}/good", 1), (f"{host}/good", 2), (f"{host}/third", 3), (f"{host}/never", 4), ("file:///etc/hostname", 5), (None, 6)], "url string, content int")
    seen = [{r["url"].rpartition("/")[2]: (r["state"], r["attempts"]) for r in remote.fetch(urls, store, timeout=5, tasks=2).collect()} for _ in range(2)]
    server.shutdown()
    assert seen[0] == {"good": ("fetched", 1), "third": ("fetched", 3), "never": ("failed", 4), "hostname": ("failed", 0)}
    assert seen[1] == {"good": ("present", 0), "third": ("present", 0), "never": ("failed", 4), "hostname": ("failed", 0)}
    assert Flaky.asked == {"/good": 1, "/third": 3, "/never": 8}
    assert sorted(bytes(r["content"]) for r in spark.read.parquet(store).collect()) == [b"body of /good", b"body of /third"]
    assert remote.fetch(urls.limit(0), str(tmp_path / "nothing")).collect() == []


def test_install_is_all_or_nothing(spark, tmp_path):
    root = f"file://{tmp_path}"
    pages = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "")], "document string, page int, body string")
    state = tmp_path / "states" / "b.json"
    state.parent.mkdir()
    state.write_text("old")
    with pytest.raises(ValueError, match="state of b"):
        release.install(pages, root, "r1", {"b": "other"})
    (tmp_path / "documents" / "document=b").mkdir(parents=True)
    with pytest.raises(FileExistsError):
        release.install(pages, root, "r1", {"b": "old"})
    assert os.listdir(tmp_path / "documents") == ["document=b"] and state.read_text() == "old" and not (tmp_path / "receipts").exists()
    (tmp_path / "documents" / "document=b").rmdir()
    real, calls = release._write_text, []

    def fails(spark, path, text):
        calls.append(path)
        if path.endswith("receipts/r1.json"):
            raise OSError("no receipt")
        real(spark, path, text)

    release._write_text = fails
    try:
        with pytest.raises(OSError, match="no receipt"):
            release.install(pages, root, "r1", {"b": "old"})
    finally:
        release._write_text = real
    assert os.listdir(tmp_path / "documents") == [] and state.read_text() == "old" and not (tmp_path / "states" / "a.json").exists()
    release.install(pages, root, "r1", {"a": None, "b": "old"})
    got = spark.read.parquet(f"{root}/documents").select("document", "page", "body").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, pages.collect()), key=str) and state.read_text() != "old"
    with pytest.raises(FileExistsError):
        release.install(pages.filter("document = 'c'"), root, "r1")
    assert not [x for x in os.listdir(tmp_path) if x.startswith("staging")]


def test_lock(spark, tmp_path):
    path = f"file://{tmp_path}/lock"
    a, b = jobs.Lock(spark, path, "a"), jobs.Lock(spark, path, "b")
    assert a.holder() is None and not a.release()
    a.acquire()
    for other in (a, b):
        with pytest.raises(jobs.Busy):
            other.acquire()
    a.beat()
    with pytest.raises(jobs.Busy):
        b.beat()
    assert not b.release()
    os.utime(tmp_path / "lock", (time.time() - 700,) * 2)
    b.acquire()
    with pytest.raises(jobs.Busy):
        a.beat()
    assert not a.release() and b.release() and b.holder() is None
    (tmp_path / "lock").write_text("{")
    with pytest.raises(jobs.Busy, match="not yet recorded"):
        a.acquire()
    os.utime(tmp_path / "lock", (time.time() - 1300,) * 2)
    a.acquire()
    assert a.release()


def test_cadence(spark, tmp_path):
    t = [datetime(2024, 1, 1, 0, m, s) for m, s in ((1, 59), (2, 0))]
    df = spark.createDataFrame([(x, y) for x in t for y in (None, datetime(2024, 1, 1))], "ts timestamp, before timestamp")
    got = df.select(jobs.due(F.col("ts"), F.col("before"), F.lit(datetime(2024, 1, 1))).alias("d")).collect()
    assert [r["d"] for r in got] == [False, False, True, True]
    spark.range(5).write.parquet(str(tmp_path / "in"))
    rows = []
    run = jobs.start_every(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda x, k: rows.append((k, x.count())), str(tmp_path / "check"), 0.2)
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    assert rows == [(0, 5)]


def test_next_batch(spark):
    work = "document string, position int, lane int, mode string, page int"
    fresh = spark.createDataFrame([("a", 1, 1), ("b", 1, 7), ("b", 1, 2), ("b", 1, 2), ("c", 2, 1)], "document string, priority int, page int")
    recovery = spark.createDataFrame([("y", 2, 1, "primary", 1), ("x", 1, 3, "audit", 4), ("x", 1, 2, "witness", 9), ("x", 1, 2, "witness", 8)], work)
    get = lambda *a: [tuple(r) for r in jobs.next_batch(*a).orderBy("page").collect()]
    assert get(recovery, fresh, "a", 5) == [("x", "witness", 8), ("x", "witness", 9)]
    none = recovery.limit(0)
    assert get(none, fresh, None, 5) == [("a", "new", 1)] == get(none, fresh, "b", 5)
    assert get(none, fresh, "a", 1) == [("b", "new", 2)] and len(get(none, fresh, "a", 5)) == 2
    assert get(none, fresh.limit(0), None, 5) == []


def test_records_of_alerts(spark):
    r = spark.createDataFrame([("a", i, i in (1, 3, 4)) for i in range(6)] + [("b", 0, None)], "key string, i int, closed boolean")
    keep = lambda most: [x["i"] for x in jobs.keep_records(r.filter("key = 'a'"), ["key"], ["i"], most).orderBy("i").collect()]
    assert keep(6) == list(range(6)) and keep(5) == [0, 2, 3, 4, 5] and keep(3) == [0, 2, 5]
    with pytest.raises(Exception, match="too many open records"):
        keep(2)
    assert jobs.keep_records(r, ["key"], ["i"], 5).count() == 6
