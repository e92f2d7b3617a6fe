"""Archives bound to recorded sums, and URLs fetched with bounded retries."""

from __future__ import annotations

import io
import tarfile
import urllib.request
import zipfile
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.session import ship, written

from . import read_optional

#: Attempts at a URL and seconds of each.
ATTEMPTS, TIMEOUT = 4, 45.0
#: Bytes of members after which a task hands on a batch.
BATCH = 16 << 20


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    """file, sha256 of a sums file, one `<64 hex digits>  <name>` a line; any other line but a blank one is an error."""
    pattern = r"^([0-9a-f]{64})\s+\*?(\S.*?)\s*$"
    lines = spark.read.text(path).filter("trim(value) <> ''")
    sound = F.when(F.col("value").rlike(pattern), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a line of sums: "), "value")))
    return lines.select(F.regexp_extract(sound, pattern, 2).alias("file"), F.regexp_extract(sound, pattern, 1).alias("sha256"))


def members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """name, content of the regular files of a zip or tar archive (plain, gz, bz2, xz, zst), one at a time. A link or a name that leaves the archive is an error."""

    def safe(inner: str) -> str:
        if inner.startswith("/") or ".." in inner.split("/"):
            raise ValueError(f"{name}: unsafe member {inner!r}")
        return inner

    if name.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for x in z.infolist():
                if not x.is_dir():
                    yield safe(x.filename), z.read(x)
        return
    stream = io.BytesIO(content)
    if name.endswith(".zst"):
        import zstandard

        stream = zstandard.ZstdDecompressor().stream_reader(stream)
    with tarfile.open(fileobj=stream, mode="r|" if name.endswith(".zst") else "r|*") as t:
        for x in t:
            if x.issym() or x.islnk():
                raise ValueError(f"{name}: link {x.name!r}")
            if x.isfile():
                yield safe(x.name), t.extractfile(x).read()


def _unpack(batches):
    schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("content", pa.binary())])

    def batch(rows):
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    rows, size = [], 0
    for b in batches:
        for name, content in zip(b["file"], b["content"]):
            for member, data in members(name.as_py(), content.as_py()):
                rows.append((name.as_py(), member, data))
                size += len(data)
                if size > BATCH:
                    yield batch(rows)
                    rows, size = [], 0
    yield batch(rows)


def read_archives(spark: SparkSession, path: str, sums: DataFrame, pattern: str = "*") -> DataFrame:
    """archive, member, content of the archives of a folder, once each of them has the sum recorded for it (SRC-06).

    sums: file, sha256. An archive that is missing, unknown or differs is an error, and nothing is unpacked. An archive is one row of
    at most 2 GB and is read by one task; it is read twice, so that its bytes are never shuffled. Spark's reader does not see files
    without a byte: one that has a sum is missing. No archives and no sums: no rows.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.substring_index("path", "/", -1).alias("file"), "content")
    found = files.select("file", F.sha2("content", 256).alias("found"))
    j = found.join(sums.select("file", F.col("sha256").alias("want")), "file", "full_outer")
    what = F.when(F.col("found").isNull(), "missing").when(F.col("want").isNull(), "unknown").when(F.col("found") != F.col("want"), "differs")
    bad = j.select("file", what.alias("problem")).filter("problem IS NOT NULL").orderBy("file").limit(10).collect()
    if bad:
        raise ValueError("archives: " + ", ".join(f"{r['file']} {r['problem']}" for r in bad))
    return files.mapInArrow(_unpack, "archive string, member string, content binary")


def get(url: str, attempts: int = ATTEMPTS, timeout: float = TIMEOUT) -> tuple[int, bytes | None, str | None]:
    """The attempts made, the body, or the last error. Only http, https and data URLs."""
    if urlsplit(url).scheme not in ("http", "https", "data"):
        return 0, None, "scheme"
    error = None
    for k in range(1, attempts + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:
                return k, r.read(), None
        except (OSError, ValueError) as e:  # URLError and timeouts are OSErrors
            error = f"{type(e).__name__}: {e}"[:200]
    return attempts, None, error


STORED = "url string, attempts int, content binary, sha256 string, error string"


def fetch(urls: DataFrame, store: str, attempts: int = ATTEMPTS, timeout: float = TIMEOUT, tasks: int = 8) -> DataFrame:
    """url, state (present, fetched, failed), attempts, error of each distinct URL; bodies are rows of the table `store` (SRC-10).

    A URL whose body is stored is not asked for again; one that failed before is. What one run fetched stays, whatever fails
    beside it. A task that is run again asks again, and only one of its outputs is committed. A null url is left out. tasks: requests at a time.
    """
    spark = urls.sparkSession
    ship(spark)
    urls = urls.select("url").filter("url IS NOT NULL").distinct()
    have = written(read_optional(spark, store, STORED).filter("error IS NULL").select("url").distinct())
    todo = urls.join(have, "url", "left_anti").repartition(tasks)

    def ask(batches):
        schema = pa.schema([("url", pa.string()), ("attempts", pa.int32()), ("content", pa.binary()), ("sha256", pa.string()), ("error", pa.string())])
        for b in batches:
            for url in b["url"].to_pylist():
                k, body, error = get(url, attempts, timeout)
                yield pa.RecordBatch.from_pylist([{"url": url, "attempts": k, "content": body, "sha256": None, "error": error}], schema)

    got = todo.mapInArrow(ask, STORED).withColumn("sha256", F.sha2("content", 256))
    run = written(got)
    run.filter("error IS NULL").write.mode("append").parquet(store)
    new = run.select("url", F.when(F.col("error").isNull(), "fetched").otherwise("failed").alias("state"), "attempts", "error")
    old = urls.join(have, "url", "left_semi").select("url", F.lit("present").alias("state"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))
    return new.unionAll(old)
