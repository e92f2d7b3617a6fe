"""The pipeline's stages against plain versions, each on what the one before it kept."""

import corpus_pipeline as C
import numpy as np
import pyarrow.parquet as pq
from quarrylight.llm import tokens, toxicity

from . import brute


def plain(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    frames = {}
    for i, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = frames[name] = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(C.STAGES) - 1:
            assert docs.columns == list(C.COLUMNS)
            kept[name] = plain(docs)
    start = plain(spark.read.parquet(f"{sf}/documents.parquet"))
    first, second, third, fourth = (kept[n] for n, _ in C.STAGES[:-1])
    # toxicity: those that the scores reject are gone, all others are as they were
    base = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(base, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(base, model).collect()}
    assert sorted(first) == sorted((d, t) for d, t in start if scores[d] < C.TOXIC)
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    clean = [d for d, t in labels.items() if not t]
    assert len({d for d, _ in first} & set(clean)) >= 0.97 * len(clean)
    # lines
    assert sorted(second) == sorted((d, t) for d, _, _, t in brute.lines(first))
    # near-duplicates
    comp = brute.components(second)
    assert sorted(third) == sorted((d, t) for d, t in second if comp[d][1] == d)
    # mixing: every document, at most twice
    assert set(fourth) == set(third) and max(fourth.count(x) for x in set(fourth)) <= 2
    # packing: every id of every document, once
    total = sum(len(x) + 1 for x in tokens.encoder(C.VOCABULARY).encode([t or "" for _, t in fourth]))
    pieces = frames[C.STAGES[-1][0]].collect()
    assert sum(r["length"] for r in pieces) == total
    assert np.bincount([r["start"] == 0 for r in pieces])[1] == len(fourth)


def small(spark, tmp_path, rows, name, labels):
    """A folder with documents (extra columns among them) and labels."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, position int"
    spark.createDataFrame([(*r, "s", "k", 1) for r in rows], kind).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    return f"file://{tmp_path}/{name}"


def test_run_with_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, ids that repeat with other texts, extra columns with clashing names: every id of what stays is packed once."""
    text = "some words that are long enough to be shingled and kept by all the stages of it"
    rows = [
        (0, text, "en", "a", 79), (0, text, "en", "a", 79), (0, "another text under an id that is taken already, with words of its own", "en", "a", 1), (1, None, None, None, None), (2, "", "de", "b", 0),
        (None, text + " but without an id", "en", "a", 5), (None, None, None, None, None), (3, "quite another line of prose which two of the documents share", None, "b", 8), (4, "Quite another  line of prose which two of the documents share", "en", None, 8), (5, "x " * 20000, "en", "a", 40000),
    ]
    sf = small(spark, tmp_path, rows, "odd", [(0, 1, 0), (1, None, None), (None, 1, 1)])
    pieces = C.run(spark, sf).collect()
    whole = [r for r in pieces if r["start"] == 0]
    ids = [r["doc_id"] for r in whole]
    assert {0, 1, 2, 3, 5, None} <= set(ids) and 4 not in ids  # 4 is a copy of 3
    reads = {d: sum(r["doc_tokens"] for r in whole if r["doc_id"] == d) for d in set(ids)}
    assert all(sum(r["length"] for r in pieces if r["doc_id"] == d) == n for d, n in reads.items())


def test_run_on_empty_tables(spark, tmp_path):
    assert C.run(spark, small(spark, tmp_path, [], "empty", [])).collect() == []
    one = small(spark, tmp_path, [(7, None, None, None, None)], "one", [])
    assert [(r["doc_id"], r["length"]) for r in C.run(spark, one).collect()] == [(7, 1)]
