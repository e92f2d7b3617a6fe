"""Releases: immutable folders, a manifest with counts and digests, and numbered pointers, of which the last one holds."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside, then rename to a name that is not taken: a reader sees all of the text or no file."""
    fs, temp = _fs(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(temp, True)
    out.write(bytearray(text.encode()))
    out.close()
    _, final = _fs(spark, path)
    if fs.exists(final) or not fs.rename(temp, final):
        fs.delete(temp, False)
        raise FileExistsError(path)


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path).collect())  # a pointer or a manifest: one small file


def _pointers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete pointers; one small file a release."""
    fs, p = _fs(spark, f"{root}/pointers")
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def _point(spark: SparkSession, root: str, text: str) -> None:
    """A new pointer above all others; no older one is touched, so a reader at any time finds one. Of writers that meet, one takes the next number."""
    for _ in range(100):
        try:
            return _write_text(spark, f"{root}/pointers/{max(_pointers(spark, root), default=0) + 1:012d}.json", text)
        except FileExistsError:
            continue
    raise OSError(f"no free pointer in {root}")


def table_digest(df: DataFrame, keys: list[str]) -> dict:
    """Rows, and an order-free digest: the sum of row hashes."""
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("sum")).first()
    return {"rows": r["rows"], "sum": str(r["sum"]), "keys": keys}


def publish(df: DataFrame, root: str, keys: list[str], per_file: int | None = None) -> str:
    """Stage df as a new release, read it back, and only then point to it (SNK-01, SNK-12). Keys must be unique."""
    spark = df.sparkSession
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"keys {keys} are not unique")
    release = f"{root}/releases/{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    (w.option("maxRecordsPerFile", per_file) if per_file else w).parquet(release)
    want, got = table_digest(df, keys), table_digest(spark.read.schema(df.schema).parquet(release), keys)
    if want != got:
        raise ValueError("the staged release differs from its source")
    _write_text(spark, f"{root}/manifest-{release.rpartition('/')[2]}.json", json.dumps(got | {"release": release}))
    _point(spark, root, json.dumps({"manifest": f"{root}/manifest-{release.rpartition('/')[2]}.json"}))
    return release


def read_release(spark: SparkSession, root: str, fallback: str | None = None) -> DataFrame:
    """The last pointer, manifest, table, each checked; the fallback only if there never was a pointer (SRC-17)."""
    numbers = _pointers(spark, root)
    if not numbers:
        if fallback is None:
            raise FileNotFoundError(f"no release in {root}")
        return spark.read.parquet(fallback)
    pointer = _read_text(spark, f"{root}/pointers/{numbers[-1]:012d}.json")
    text = _read_text(spark, json.loads(pointer)["manifest"])
    if text is None:
        raise ValueError("the pointer's manifest is missing")
    manifest = json.loads(text)
    df = spark.read.parquet(manifest["release"])
    if table_digest(df, manifest["keys"]) != {k: manifest[k] for k in ("rows", "sum", "keys")}:
        raise ValueError("the release differs from its manifest")
    return df


def keep_generated_at(old: DataFrame | None, new: DataFrame, column: str = "generated_at") -> DataFrame:
    """The old artifact if only its time differs, else the new one (SNK-04)."""
    if old is None:
        return new
    a, b = old.drop(column), new.drop(column)
    same = a.columns == b.columns and not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()
    return old if same else new


def install(pages: DataFrame, root: str, receipt: str, seen: dict[str, str | None] | None = None) -> str:
    """All documents of a transaction, or none (SNK-14): staged, read back, moved to their places, their states renewed, and last of all a receipt.

    pages: document, page and any other columns. A document that is there already, a state other than `seen` (document -> text of the state as
    the caller read it, None if there was none), or a receipt of this name ends the transaction; what was moved is then taken away again and old states are put back.
    The driver moves one folder a document. A reader asks for the receipt first. Returns the receipt's path.
    """
    spark = pages.sparkSession
    staging = f"{root}/staging-{uuid.uuid4().hex}"
    note, done = f"{root}/receipts/{receipt}.json", []
    fs, staged = _fs(spark, staging)

    def put(path: str, text: str | None) -> None:
        """A state as it is to be; states are read only below a receipt, so none is seen in between."""
        fs.delete(_fs(spark, path)[1], False)
        if text is not None:
            _write_text(spark, path, text)

    try:
        pages.write.partitionBy("document").parquet(staging)
        back = spark.read.schema(pages.schema).parquet(staging).select(*pages.columns)
        want, got = table_digest(pages, ["document", "page"]), table_digest(back, ["document", "page"])
        if want != got:
            raise ValueError("the staged documents differ from their source")
        counts = {r["document"]: r["n"] for r in back.groupBy("document").agg(F.count(F.lit(1)).alias("n")).collect()}  # the documents of one transaction
        folders = sorted(f.getPath().getName() for f in fs.listStatus(staged) if f.isDirectory())
        if _read_text(spark, note) is not None:
            raise FileExistsError(note)
        states = {d: _read_text(spark, f"{root}/states/{d}.json") for d in counts}
        for d, text in (seen or {}).items():
            if states.get(d) != text:
                raise ValueError(f"the state of {d} has changed")
        fs.mkdirs(_fs(spark, f"{root}/documents")[1])
        for f in folders:
            target = f"{root}/documents/{f}"
            if fs.exists(_fs(spark, target)[1]) or not fs.rename(_fs(spark, f"{staging}/{f}")[1], _fs(spark, target)[1]):
                raise FileExistsError(target)
            done.append(lambda t=target: fs.delete(_fs(spark, t)[1], True))
        for d, n in counts.items():
            path = f"{root}/states/{d}.json"
            done.append(lambda p=path, t=states[d]: put(p, t))
            put(path, json.dumps({"document": d, "pages": n, "receipt": receipt}))
        _write_text(spark, note, json.dumps(got | {"documents": sorted(counts)}))
        return note
    except BaseException as e:
        for undo in reversed(done):
            try:
                undo()
            except Exception as more:
                e.add_note(f"not undone: {more}")
        raise
    finally:
        fs.delete(staged, True)
