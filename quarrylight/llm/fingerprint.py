"""Document fingerprints: every shingle hash below a fixed fraction of the hash space; of a short text, every hash.

The sketch grows with the document, so a short and a long document keep the same share of their shingles: intersections
of sketches estimate intersections of sets, whatever the sizes, and the sketch of a union is the union of sketches. A set of
at most WHOLE hashes, of which few or none may lie below the fraction, is kept whole and marked: two of these are compared exactly, one
and a longer text by what lies below the fraction.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, need, partitions
from .kernels import U, overlap, text_sets

#: A fingerprint keeps the hashes below 1 / SCALE of the hash space, at 48 bits each.
SCALE = 4
#: Sets of so many hashes are kept whole, and end with MARK.
WHOLE, MARK = 256, (1 << 48) - 1
#: Bytes of text that are taken up at a time.
CHUNK = 1 << 20


def sketch(hashes: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The upper 48 bits of the sorted distinct hashes that lie below the threshold, or of all of a short set, and MARK."""
    if 0 < len(hashes) <= WHOLE:
        return np.unique(np.append(hashes >> U(16), U(MARK)))
    return _below(np.unique(hashes[: np.searchsorted(hashes, U((1 << 64) // scale))] >> U(16)), scale)


def _below(s: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return s[: np.searchsorted(s, U((1 << 48) // scale))]


def _whole(s: np.ndarray) -> bool:
    return not len(s) or int(s[-1]) == MARK


def _level(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without marks: whole where both are, else what lies below the threshold."""
    if _whole(a) and _whole(b):
        return a[:-1], b[:-1]  # an empty one has no mark
    return _below(a), _below(b)


def to_string(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_string(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 2:] = raw
    return out.view(">u8").ravel().astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    x, y = _level(a, b)
    both = np.union1d(x, y)
    if not (_whole(a) and _whole(b)):
        return both
    return np.append(both, U(MARK)) if 0 < len(both) <= WHOLE else _below(both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has, exact if both are whole; 0 if nothing of a can be compared."""
    a, b = _level(a, b)
    return overlap(a, b) / len(a) if len(a) else 0.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity, exact if both are whole; two empty sketches, of texts without words, are alike (1), an empty one and another are not (0)."""
    if not len(a) and not len(b):
        return 1.0
    a, b = _level(a, b)
    both = overlap(a, b)
    return both / max(1, len(a) + len(b) - both)


def edited_text(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by as many, or all, characters of the next text."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, and others) with a column fingerprint, which replaces one of that name. A null text is empty; equal texts have equal fingerprints; a text without words has an empty one."""
    need(docs, "text")
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def f(t: pa.Array) -> pa.Array:
        return pa.array([to_string(sketch(s)) for s in text_sets(t)], pa.string())

    return docs.withColumn("fingerprint", f(F.col("text")))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches):
    """Rows in order (group, doc_id descending); a guest row closes a group and only lends its text to the row before it."""
    last = None  # group, doc_id, text, own sketch

    def flush(todo):
        # texts of one call are hashed together: every edited text, the own sketches are at hand
        edited = [edited_text(t, nt) for _, t, _, nt, _ in todo]
        sketches = [sketch(s) for s in text_sets(pa.array(edited, pa.large_string()))]
        cols = [[], [], [], [], [], [], []]
        for (doc, t, own, _, nxt), e, se in zip(todo, edited, sketches):
            row = (doc, len(t), hashlib.sha256(e.encode()).hexdigest(), to_string(own), to_string(se), likeness(own, se), likeness(own, nxt))
            for c, v in zip(cols, row):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in OUT.split(", ")])

    for batch in batches:
        sizes = np.asarray(pa.compute.binary_length(batch.column("text").cast(pa.large_string())).fill_null(0))
        total = np.concatenate([[0], np.cumsum(sizes)])
        a, n = 0, batch.num_rows
        while a < n:
            b = min(n, max(a + 1, int(np.searchsorted(total, total[a] + CHUNK, side="right")) - 1))
            part = batch.slice(a, b - a)
            a = b
            texts = part.column("text")
            todo = []
            rows = zip(part.column("grp").to_pylist(), part.column("guest").to_pylist(), part.column("doc_id").to_pylist(), texts.to_pylist(), text_sets(texts))
            for grp, guest, doc, text, s in rows:
                text, own = text or "", sketch(s)
                if last is not None and last[0] == grp:
                    todo.append((last[1], last[2], last[3], text, own))
                last = None if guest else (grp, doc, text, own)
            if todo:
                yield flush(todo)


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of an edited text and of the next document, in descending doc_id; after the last comes the first.

    docs: doc_id, text; other columns are ignored. A null text is empty. Rows without a doc_id come after all others; rows that share
    one follow each other by the hash of their texts. A single row is its own next. An empty table gives an empty result.
    The documents are cut into ranges of doc_id, one a partition; each range also gets, as a guest, the first document of the next range, so
    one exchange is enough.
    """
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    n = partitions(spark)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    ids = docs.select(order.alias("k"))
    cuts = sorted(set(ids.approxQuantile("k", [i / n for i in range(1, n)], 1 / (8 * n)))) if n > 1 else []
    # n - 1 bounds; range i holds the keys above bound i - 1 and up to bound i
    bounds = F.array(*[F.lit(int(c)) for c in cuts]).cast("array<long>")
    grp = F.size(F.filter(bounds, lambda c: c < order)).cast("int")
    first = {r["grp"]: r["k"] for r in docs.select(grp.alias("grp"), order.alias("k")).groupBy("grp").agg(F.max("k").alias("k")).collect()}  # one row a range
    if not first:
        return spark.createDataFrame([], OUT)
    down = sorted(first, reverse=True)
    lend = [(down[(i + 1) % len(down)], first[down[(i + 1) % len(down)]], g) for i, g in enumerate(down)]
    lends = F.create_map(*[F.lit(x) for g, _, to in lend for x in (g, to)])
    heads = F.create_map(*[F.lit(x) for g, k, _ in lend for x in (g, int(k))])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", grp.alias("own"), order.alias("k"))
    home = F.struct(F.col("own").alias("grp"), F.lit(False).alias("guest"))
    away = F.struct(F.element_at(lends, F.col("own")).alias("grp"), F.lit(True).alias("guest"))
    rows = rows.select("doc_id", "text", "k", F.inline(F.when(F.col("k") == F.element_at(heads, F.col("own")), F.array(home, away)).otherwise(F.array(home))))
    rows = rows.repartitionById(n, F.col("grp")).sortWithinPartitions("grp", "guest", F.desc("k"), F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.select("doc_id", "text", "grp", "guest").mapInArrow(lean(_compare), OUT)
