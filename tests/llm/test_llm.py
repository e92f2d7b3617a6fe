"""The corpus operators against plain versions, on texts with nulls, copies, ties, very long rows and clashing columns."""

import collections
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylight.llm import ann, fingerprint, induced, kernels, line_dedup, minhash, mixing, packing, pfor, registry, suffix_dedup, token_counts, tokens, toxicity

from .. import oracle
from . import brute

VOCABULARY = "byte_bpe_50k.json"


def prose(rng, n):
    return " ".join(rng.choice(["the", "Anther", "é", "tion,", "sh.", "ou\n"]) + str(rng.randint(0, 300)) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 160)) for _ in range(40)]
    line = "  A line that is shared by many and long enough to count  "
    out = list(base)
    for t in base[:20]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "other"
        out += [t, " ".join(w), t + "\n" + line.upper(), prose(rng, 30) + base[3][:250] + prose(rng, 30)]
    out += ["", "\n", " ", "one", "One", "two words", "same same " * 300, "=" * 1000, prose(rng, 20000), line, f"{line}\n{line}\nx"]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(texts())) + [(1000, None)]


def odd(rows):
    """Also a repeated row, a repeated id with another text, rows without an id."""
    return rows + [rows[0], (5, "another text under an id that is taken"), (None, rows[1][1]), (None, None)]


def clash(df):
    """Extra columns, some named like what operators make."""
    return df.withColumns({"kept": F.lit("x"), "N_LINES": F.lit(1.5), "key": F.lit(None).cast("string"), "score": F.lit(True), "position": F.lit("p"), "batch": F.lit(0)})


def test_line_dedup(spark, rows):
    for r in (rows, odd(rows)):
        got = line_dedup.dedup_lines(clash(frame(spark, r)))
        assert sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["n_lines"], x["n_dropped"], x["kept_text"]) for x in got.collect()) == sorted((-1 if x[0] is None else x[0], *x[1:]) for x in brute.lines(r))
    assert sum(x[2] for x in brute.lines(rows)) > 10


def test_line_runs_compact(spark):
    """A hash stands in the run of the batch in which it was new; later batches only update its count."""
    kind = "key string, n_docs long, last_doc long"
    batches = [[("a", 1, 5), ("b", 2, 3)], [("a", 4, 2), ("c", 1, 9)], [("c", 1, 1)], [("a", 1, 8), ("d", 1, 1)], [("e", 1, 1)]]
    with line_dedup.LineRuns(spark, buckets=2) as runs:
        want: dict = {}
        for rows in batches:
            runs.add(spark.createDataFrame(rows, kind))
            for k, n, d in rows:
                m, last = want.get(k, (0, d))
                want[k] = m + n, max(last, d)
            held = [r["key"] for t in runs.tables() for r in spark.table(t).collect()]
            assert sorted(held) == sorted(want)  # each once
            assert {r["key"]: (r["n_docs"], r["last_doc"]) for r in runs.merged().collect()} == want
        assert [r["key"] for r in runs.novel(spark.createDataFrame([("a",), ("x",)], "key string")).collect()] == ["x"]
        assert sum(map(len, runs.levels.values())) < len(batches)
        assert sum(r["n_docs"] for t in runs.updates for r in spark.table(t).collect()) == 6
        name = runs.name
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(name)]


def test_repeats(spark, rows):
    for r in (rows, odd(rows)):
        got = suffix_dedup.remove_repeats(clash(frame(spark, r)))
        key = lambda x: (x[0] is None, x[0] or 0, x[1:])
        assert sorted(((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in got.collect()), key=key) == sorted(brute.repeats(r), key=key)


def test_repeats_out_of_core(spark, rows):
    """With names and queues that fit nowhere, the sort recurses and spills, to the same result."""
    got = suffix_dedup.remove_repeats(frame(spark, rows), shard=1 << 14, base=2, memory=64)
    assert sorted((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in got.collect()) == sorted(brute.repeats(rows))


def test_digests_tell_runs_apart():
    """Runs have equal digests where their bytes are equal, and only there, also for texts of much alike structure."""
    bits = "0"
    while len(bits) < 4096:
        bits += bits.translate(str.maketrans("01", "10"))
    values = [bits, bits.translate(str.maketrans("01", "10")), "ab" * 3000, "ba" * 3000, "=" * 5000, bits + "x"]
    data, off = kernels.utf8_batch(pa.array(values))
    text, start, n, _, digest, _ = suffix_dedup.runs(data, off)
    raw = [bytes(data[off[t] + s : off[t] + s + k + 199]) for t, s, k in zip(text, start, n)]
    assert len(set(raw)) == len(set(digest.tolist())) == len(set(zip(raw, digest.tolist())))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=120), st.integers(2, 12), st.booleans())
def test_induced_sort(values, length, small):
    t = np.array([*values, 0], np.uint16)
    base, memory = (2, 8) if small else (10**6, 10**6)
    plain = sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert induced.induced_order(t, len(t) + 1, base, memory).tolist() == plain
    seen = collections.Counter(tuple(values[i : i + length]) for i in range(len(values) - length + 1))
    want = [i + length <= len(values) and seen[tuple(values[i : i + length])] > 1 for i in range(len(t))]
    got = induced.repeated_starts(t, length, base, memory)
    assert got.tolist() == want


def test_queue_spills():
    q = induced.DiskQueue(memory=3)
    for i in range(5):
        q.push(i % 2, np.arange(i, i + 2), np.full(2, i, np.uint8))
    assert q.spilled and q.pop(0)[0].tolist() == [0, 1, 2, 3, 4, 5] and q.pop(1)[1].tolist() == [1, 1, 3, 3] and q.pop(7) is None


def test_runs_own_every_start(rows):
    data, off = kernels.utf8_batch(pa.array([t for _, t in rows]))
    text, start, n, *_ = suffix_dedup.runs(data, off)
    got = collections.Counter((int(t), int(s) + i) for t, s, k in zip(text, start, n) for i in range(k))
    sizes = np.diff(off)
    assert set(got.values()) <= {1} and len(got) == int(np.maximum(sizes - 199, 0).sum())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAé \n\t.\x00", max_size=40) | st.none(), min_size=1, max_size=8))
def test_shingle_sets(values):
    sets = list(kernels.text_sets(pa.array(values, pa.string())))
    plain = [brute.shingles(v) for v in values]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for i in range(len(values)):
        for j in range(len(values)):
            assert kernels.overlap(sets[i], sets[j]) == len(plain[i] & plain[j])


def test_fingerprints(spark, rows):
    for r in (rows, odd(rows)):
        got = fingerprint.compare_with_edited(clash(frame(spark, r))).collect()
        assert len(got) == len(r)
    got = {x["doc_id"]: x for x in fingerprint.compare_with_edited(frame(spark, rows)).collect()}
    down = sorted(rows, reverse=True)
    for (d, t), (_, nxt) in zip(down, down[1:] + down[:1]):
        t, nxt, m = t or "", nxt or "", len(t or "") // 3
        e = t[: len(t) - m] + nxt[:m]
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(t), brute.sha(e))
        a, b = fingerprint.from_string(got[d]["fingerprint"]), fingerprint.from_string(got[d]["edited_fingerprint"])
        assert got[d]["near_edited"] == fingerprint.likeness(a, b)
        both = brute.shingles(t) | brute.shingles(e)
        if len(both) > 300:
            assert abs(got[d]["near_edited"] - len(brute.shingles(t) & brute.shingles(e)) / len(both)) < 0.15
    same = collections.defaultdict(set)
    for d, t in rows:
        same[t or ""].add(got[d]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())


def test_sketches_merge():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2)) for _ in range(2))
    assert fingerprint.merge(fingerprint.sketch(a), fingerprint.sketch(b)).tolist() == fingerprint.sketch(np.union1d(a, b)).tolist()
    assert abs(fingerprint.containment(fingerprint.sketch(a[:400]), fingerprint.sketch(np.union1d(a[:400], b))) - 1) < 1e-9
    assert fingerprint.from_string(fingerprint.to_string(fingerprint.sketch(a))).tolist() == fingerprint.sketch(a).tolist()


def test_short_texts_have_fingerprints():
    """Texts of 1 to 12 words: different ones differ, and their likeness is that of their sets."""
    rng = random.Random(6)
    texts = ["", " ", *(" ".join(rng.choice("abc") for _ in range(k)) for k in range(1, 13) for _ in range(12))]
    plain = [brute.shingles(t) for t in texts]
    got = [fingerprint.from_string(fingerprint.to_string(fingerprint.sketch(s))) for s in kernels.text_sets(pa.array(texts))]
    assert [len(g) > 0 for g in got] == [len(p) > 0 for p in plain]
    for a, p in zip(got, plain):
        for b, q in zip(got, plain):
            assert fingerprint.likeness(a, b) == (len(p & q) / len(p | q) if p | q else 1)
            assert fingerprint.containment(a, b) == (len(p & q) / len(p) if p else 0)
    sets = list(kernels.text_sets(pa.array([prose(rng, 200), prose(rng, 150), prose(rng, 3000), "one"])))
    for a in sets:
        for b in sets:
            assert fingerprint.merge(fingerprint.sketch(a), fingerprint.sketch(b)).tolist() == fingerprint.sketch(np.union1d(a, b)).tolist()


def test_token_counts(spark, rows):
    got = token_counts.count_tokens(clash(frame(spark, odd(rows))), VOCABULARY, 50256, 50257, block=1 << 10)
    enc = tokens.encoder(VOCABULARY, True)
    want = [(d if d is not None else -1, len(x)) for (d, _), x in zip(odd(rows), enc.encode([t or "" for _, t in odd(rows)]))]
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"]) for r in got.collect()) == sorted(want)


def test_scan_stitches_blocks(spark, tmp_path):
    ids = np.array([5, 9, 9, 1, 2, 3, 4, 5, 6, 7, 9, 1, 9, 8], "<u2")  # 9 ends a document; the last id is in none
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    files = spark.createDataFrame([(f"file://{tmp_path}/a.bin", 28), (f"file://{tmp_path}/b.bin", 0)], "file string, bytes long")
    for block in (2, 4, 6, 100):
        got = sorted((r["ordinal"], r["start"], r["n_tokens"]) for r in token_counts.scan_flat_files(files, 9, 2, block).collect())
        assert got == [(0, 0, 1), (1, 2, 0), (2, 3, 7), (3, 11, 1)]


@pytest.mark.parametrize("name", [VOCABULARY, "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    rng = random.Random(4)
    parts = ["a", "Foo", "don't", " ", "  ", "\n", "\n\n", "\t", "...", "é", "漢字", "1", "<|endoftext|>", "|", " | ", "\x85", "\x1c", "́", " "]
    values = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 15))) for _ in range(1500)] + texts()
    e = tokens.Encoder(tokens.vocabulary_path(name), cache=500)
    got = [x.tolist() for _, b in e.batches(pa.array(values), 5000) for x in b]
    assert got == [x.ids for x in e.tok.encode_batch(values, add_special_tokens=False)]


def test_mixing(spark, rows):
    sources = ["big"] * 8 + ["small", None]
    data = [(d, t, sources[(i * 7) % 10]) for i, (d, t) in enumerate(odd(rows))]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix_sources(clash(df), max_repeat=2.0, block_docs=8).collect()
    words = collections.Counter()
    for _, t, s in data:
        words[s] += len(brute.WORD.findall(t or ""))
    reads = collections.Counter((r["doc_id"], r["text"], r["source"]) for r in got)
    assert set(reads) == set(data)  # everything is read
    top = max(words.values())
    for s in words:
        mine = [r for r in got if r["source"] == s]
        epochs = mine[0]["epochs"]
        assert 1 <= epochs <= 2 + 1e-9 and (words[s] < top or epochs == 1)
        spent = sum(r["n_tokens"] for r in mine)
        assert spent >= epochs * words[s] - 1 and spent <= epochs * words[s] + max(r["n_tokens"] for r in mine)
        for e in {r["epoch"] for r in mine}:
            at = 0
            for r in sorted((r for r in mine if r["epoch"] == e), key=lambda r: (r["tokens_before"], r["n_tokens"])):
                assert r["tokens_before"] == at
                at += r["n_tokens"]
        assert all(0 <= r["position"] <= 1 for r in mine)
    low = mixing.mix_sources(df, max_repeat=None, target_entropy=0.5)
    w = {r["source"]: r["weight"] for r in low.collect()}
    assert -sum(x * np.log(x) for x in w.values()) <= 0.5 + 1e-6


def test_packing(spark, rows):
    data = odd(rows)
    got = [r.asDict() for r in packing.pack_documents(clash(frame(spark, data)), VOCABULARY, 0).collect()]
    enc = tokens.encoder(VOCABULARY)
    want = collections.Counter(tuple([*x.tolist(), 0]) for x in enc.encode([t or "" for _, t in data]))
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append(r)
    pad = total = 0
    for s in seqs.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == np.cumsum([0] + [r["length"] for r in s])[:-1].tolist()
        n = sum(r["length"] for r in s)
        assert 0 < n <= 1024
        total, pad = total + n, pad + (0 if n & (n - 1) == 0 else 1024 - n)
    assert total == sum(map(len, want.elements())) and pad < 0.05 * total
    # the pieces of each text, in order, are its ids
    crc = collections.Counter()
    for t in want.elements():
        crc[len(t)] += 1
    assert collections.Counter(r["doc_tokens"] for r in got if r["start"] == 0) == crc
    single = [r for r in got if r["length"] == r["doc_tokens"]]
    sums = {zlib.crc32(np.array(t, "<u4").tobytes()) for t in want}
    assert single and all(r["ids_crc32"] in sums for r in single)


@settings(max_examples=80, deadline=None)
@given(st.sets(st.integers(1, 60), max_size=25), st.integers(1, 60), st.integers(0, 3))
def test_packing_is_optimal(places, n, seed):
    size = 16
    at = np.array(sorted({0, n, *range(0, n, 5), *(p for p in places if p < n)}))
    cost = np.random.default_rng(seed).integers(0, 6, len(at))
    cost[0] = cost[-1] = 0
    cuts = packing.solve(at, cost, size)
    pad = lambda k: 0 if k & (k - 1) == 0 else size - k
    price = dict(zip(at.tolist(), cost.tolist()))
    best = {0: 0}
    for p in at.tolist()[1:]:
        best[p] = min(best[q] + pad(p - q) + price[p] for q in best if 0 < p - q <= size)
    assert cuts[-1] == n and sum(pad(b - a) + price[b] for a, b in zip([0, *cuts], cuts)) == best[n]


def test_packing_considers_every_cut():
    """Every sentence end offers the place a whole window later, and short powers of two count anywhere in the stream."""
    rng = np.random.default_rng(8)
    ends = np.flatnonzero(rng.random(20000) < 0.05) + 1
    doc_ends = np.append(ends[::15], 20000)
    at, cost = packing.cut_places(ends, doc_ends, 20000, 1024, False)
    whole = np.union1d(np.union1d([0], ends), doc_ends) + 1024
    assert np.isin(whole[whole < 20000], at).all() and set(cost.tolist()) == {0, packing.SENTENCE, packing.ANYWHERE}
    at = np.array([0, 8, 1032, 2056, 3080])
    assert packing.solve(at, np.zeros(5, int), 1024) == [8, 1032, 2056, 3080]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 70), min_size=1, max_size=300), st.floats(0.05, 1))
def test_blocks_round_trip(values, fit):
    ids = np.array(values, np.uint32)
    assert pfor.decode_block(pfor.encode_block(ids, fit)).tolist() == values


def test_id_files(spark, rows):
    out = io.BytesIO()
    w = pfor.Writer(out, block=7)
    docs = [(3, [1, 2, 3]), (None, []), (4, list(range(40))), (5, [2**31])]
    for d, x in docs:
        w.add(d, np.array(x, np.uint32))
    w.close()
    r = pfor.Reader(pa.BufferReader(out.getvalue()))
    assert [(d, np.concatenate(p).tolist() if p else []) for d, p in r.documents()] == docs
    assert r.block(2).tolist() == list(range(11, 18))
    with pytest.raises(ValueError):
        pfor.Reader(pa.BufferReader(out.getvalue()[:-1]))
    got = sorted(tuple(x) for x in pfor.round_trip(clash(frame(spark, rows)), "word_bpe_49k.json", 1).collect())
    at, want = 0, []
    for (d, _), x in zip(rows, tokens.encoder("word_bpe_49k.json").encode([t or "" for _, t in rows])):
        x = np.append(x, np.uint32(1))
        want.append((d, at, len(x), zlib.crc32(x.astype("<u4").tobytes())))
        at += len(x)
    assert got == want
    again = pfor.round_trip(frame(spark, odd(rows)), "word_bpe_49k.json", 1).collect()
    assert len(again) == len(odd(rows)) and sorted(r["start"] for r in again)[0] == 0


def test_minhash(spark, rows):
    want = brute.components(rows)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(clash(frame(spark, rows))).collect()}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())
    assert len({c for _, c in want.values()}) < len(rows) - 20
    more = minhash.near_duplicates(frame(spark, odd(rows))).collect()
    assert len(more) == len(odd(rows)) and all(r["kept"] and r["component_id"] is None for r in more if r["doc_id"] is None)


def test_minhash_opens_buckets(spark, monkeypatch):
    """Texts that share much with the centre but not enough still meet each other, also where buckets must be split."""
    rng = random.Random(2)
    core = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(core[:70] + [f"x{i // 2}_{k}" for k in range(50)] + [f"y{i}"])) for i in range(60)]
    rows.append((100, " ".join(core)))
    want = brute.components(rows)
    assert 20 < len({c for _, c in want.values()}) < 60
    for held, depth in ((4096, 2), (4, 2), (7, 1)):
        monkeypatch.setattr(minhash, "HELD", held)
        monkeypatch.setattr(minhash, "DEPTH", depth)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
        assert got == want
    del rng


def test_filter_holds_every_slot(spark):
    """Also the ids whose hash is 0 within the filter."""
    ids = [25317696, 60270852, 64977102, 1, 2, 3]
    nodes = spark.createDataFrame([(i,) for i in ids], "node long")
    zero = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(minhash.FILTER)) == 0).count()
    more = nodes.union(spark.createDataFrame([(i,) for i in range(1000, 1200)], "node long"))
    got = [r["node"] for r in more.filter(minhash._wanted(nodes)).collect()]
    assert zero == 3 and set(ids) <= set(got) and len(got) < 20


def test_screen_keeps_short_texts():
    """One crowded bucket of texts of 20 to 100 words: no pair of similarity 0.75 or more is dropped, and most others are."""
    rng = random.Random(4)
    texts = []
    for k in range(300):
        w = [f"b{k}w{i}" for i in range(rng.randint(20, 100))]
        u = len(w) - 4  # a tail that is replaced leaves the sets' similarity at (u - m) / (u + m)
        m = rng.choice([x for x in range(1, u) if 0.75 <= (u - x) / (u + x) <= 0.82] or [1])
        texts += [" ".join(w), " ".join(w[: len(w) - m] + [f"c{k}w{i}" for i in range(m)])]
    sets = list(kernels.text_sets(pa.array(texts)))
    n = np.array([len(s) for s in sets])
    got = {(int(a), int(b)) for i, j in minhash.near_pairs(minhash.fine_bins(sets), np.arange(len(sets)), n, 75, 100) for a, b in zip(i, j)}
    plain = [brute.shingles(t) for t in texts]
    want = {(a, a + 1) for a in range(0, len(texts), 2) if 100 * len(plain[a] & plain[a + 1]) >= 75 * len(plain[a] | plain[a + 1])}
    assert len(want) > 250 and want <= got and len(got) < 2 * len(texts)


@pytest.mark.parametrize("union", [4, 8, 20, 40, 80, 100, 200, 400, 800])
def test_recall_at_the_threshold(union):
    """Pairs of similarity 0.75 exactly, by size of the union: they share a band, and the screen of open buckets lets them pass."""
    rng = np.random.default_rng(union)
    sets = []
    for _ in range(300):
        h = np.unique(rng.integers(0, 2**64, union, dtype=np.uint64))
        own = rng.permutation(len(h))[: union // 4]
        side = rng.integers(0, 2, len(own)) == 0
        sets += [np.delete(h, own[side]), np.delete(h, own[~side])]
    keys = minhash.band_keys(minhash.signatures(sets))
    assert all((keys[i] == keys[i + 1]).any() for i in range(0, len(sets), 2))
    got = {(int(a), int(b)) for i, j in minhash.near_pairs(minhash.fine_bins(sets), np.arange(len(sets)), np.array([len(s) for s in sets]), 75, 100) for a, b in zip(i, j)}
    assert {(i, i + 1) for i in range(0, len(sets), 2)} <= got


def test_minhash_keeps_links_below_the_stars(spark):
    """Texts that share most words with all others, too few to be linked, but for one partner each at 30 of 40."""
    n = 240
    rows = [(i, " ".join([f"c{k}" for k in range(33)] + [f"p{i // 2}"] + [f"u{i}_{k}" for k in range(5)])) for i in range(n)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: i // 2 * 2 for i in range(n)}


def test_hashes_tell_alike_words_apart():
    """Two words whose difference vanishes under a polynomial in any odd base modulo 2^64."""
    bits = "0"
    while len(bits) < 4096:
        bits += bits.translate(str.maketrans("01", "10"))
    one, two = bits.translate(str.maketrans("01", "ab")), bits.translate(str.maketrans("01", "ba"))
    a, b = kernels.text_sets(pa.array([one, two]))
    assert kernels.overlap(a, b) == 0


def test_signature_estimates():
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64) * np.uint64(2))
    a, b = pool[:700], pool[100:]
    sig = minhash.signatures([np.sort(a), np.sort(b), pool[:1]])
    share = (sig[0] == sig[1]).mean()
    assert abs(share - 600 / len(pool)) < 0.12 and len(set(sig[2].tolist())) == 1


def test_components_long_chain(spark):
    from quarrylight.llm.common import Scratch

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["comp"] for r in minhash.components(links, links, Scratch(spark, "t"), "c").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 9)).astype(np.float32)
    x[7] = x[8] = x[9]
    x[11] *= 1e-30
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [0.0] * 9), (402, [float("nan")] * 9), (403, [float("inf")] + [1.0] * 8), (404, [None] + [1.0] * 8), (405, []), (500, [1.0, 2.0]), (501, [3.0, 4.0]), (None, x[3].tolist())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("rank", F.lit("r"))
    for k, block in ((20, 64), (400, 1000), (1, 7)):
        got = collections.defaultdict(list)
        for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), k, block).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        y = x.astype(float)
        assert sorted(got) == [*range(0, 300, 20), 500]
        for qid in range(0, 300, 20):
            s = [(-float(ann.exact_products(y[[qid]], y[[i]])[0]), i) for i in range(300) if i != qid]
            assert got[qid] == [(j + 1, i, -v) for j, (v, i) in enumerate(sorted(s)[:k])]
        assert got[500] == [(1, 501, 11.0)]


def test_toxicity(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(400):
        t = prose(rng, rng.randint(5, 120))
        bad = i % 5 == 0
        if bad:
            w = t.split(" ")
            for _ in range(2):
                w.insert(rng.randrange(len(w) + 1), rng.choice(["vileXa", "grim", "foulen", "foulest"]))
            t = " ".join(w)
        rows.append((i, t))
        marks.append((i, 0, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "grim"), (3, rows[3][1])]
    docs, labels = frame(spark, rows), spark.createDataFrame([*marks, (0, 0, None), (7, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score_documents(clash(docs), model).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in marks}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    hit = {r["doc_id"]: r["score"] >= 0.7 for r in got}
    assert sum(hit[i] == bool(truth[i]) for i in held) >= 0.95 * len(held)
    by = dict(rows)
    for r in got:
        for s in r["spans"] if r["doc_id"] in by else ():
            assert any(w in by[r["doc_id"]][s["start"] : s["end"]] for w in ("vile", "grim", "foul"))
        assert 0 <= r["score"] <= 1
    carried = toxicity.score_documents(clash(docs), model, carry=True)
    assert set(carried.columns) == {*clash(docs).columns, "spans"} and carried.count() == len(rows)
    nothing = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert {r["score"] for r in toxicity.score_documents(docs, nothing).collect()} == {0.0}


def test_forward_backward():
    rng = np.random.default_rng(8)
    e, edges = rng.normal(size=(4, 3)), rng.normal(size=(2, 2))
    on = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], bool)
    p, pairs, z = toxicity.forward_backward(e, on, edges)
    total = np.zeros((2, 2))
    for c in range(3):
        n = int(on[:, c].sum())
        weight, mark = 0.0, np.zeros(n)
        both = np.zeros((2, 2))
        for bits in range(2**n):
            y = [bits >> i & 1 for i in range(n)]
            w = np.exp(sum(e[i, c] for i in range(n) if y[i]) + sum(edges[y[i - 1], y[i]] for i in range(1, n)))
            weight += w
            mark += w * np.array(y)
            for i in range(1, n):
                both[y[i - 1], y[i]] += w
        assert np.allclose(p[:n, c], mark / weight) and np.isclose(z[c], np.log(weight))
        total += both / weight
    assert np.allclose(pairs, total)


def test_held_out(spark):
    got = {r["id"]: r["h"] for r in spark.range(200).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(200)}


EMPTY = {
    "line": lambda df: line_dedup.dedup_lines(df),
    "repeats": lambda df: suffix_dedup.remove_repeats(df),
    "fingerprints": lambda df: fingerprint.compare_with_edited(df),
    "counts": lambda df: token_counts.count_tokens(df, VOCABULARY, 50256, 50257),
    "mixing": lambda df: mixing.mix_sources(df.withColumn("source", F.lit("s"))),
    "packing": lambda df: packing.pack_documents(df, VOCABULARY, 0),
    "files": lambda df: pfor.round_trip(df, "word_bpe_49k.json", 1),
    "minhash": lambda df: minhash.near_duplicates(df),
    "toxicity": lambda df: toxicity.score_documents(df, toxicity.fit(df, df.select("doc_id", F.lit(1).alias("toxic")))),
    "nearest": lambda df: ann.nearest(df.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding")), df.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"))),
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables(spark, name):
    assert EMPTY[name](spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_with_sql(spark, sf, name):
    oracle.assert_same(oracle.connection(sf), registry.queries()[name](spark, sf), registry.oracle_sql()[name])


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.queries()) == list(range(1, 11))


def test_registered_queries_equal_plain_versions(spark, tmp_path, rows):
    """op2, op3, op4, op8 and op9 as they are registered, over a folder of their own."""
    frame(spark, rows).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")}).write.parquet(f"{tmp_path}/documents.parquet")
    q = {k.split("_")[0]: f for k, f in registry.queries().items()}
    run = lambda k: {r["doc_id"]: r for r in q[k](spark, f"file://{tmp_path}").collect()}
    got = run("op2")
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == {d: (a, b, c, brute.sha(k)) for d, a, b, c, k in brute.repeats(rows)}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in run("op9").items()} == brute.components(rows)
    got = run("op3")
    down = sorted(rows, reverse=True)
    for (d, t), (nd, nxt) in zip(down, down[1:] + down[:1]):
        t, nxt = t or "", nxt or ""
        m = len(t) // 3
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(t), brute.sha(t[: len(t) - m] + nxt[:m]))
        a, b = (fingerprint.from_string(got[x]["fingerprint"]) for x in (d, nd))
        assert got[d]["near_next"] == fingerprint.likeness(a, b)
        sets = brute.shingles(t), brute.shingles(nxt)
        if max(map(len, sets)) <= fingerprint.WHOLE:
            assert got[d]["near_next"] == (len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1)
    raw = tokens.encoder(VOCABULARY, True).tok
    assert {d: r["n_tokens"] for d, r in run("op4").items()} == {d: len(raw.encode(t or "", add_special_tokens=False).ids) for d, t in rows}
    raw, at = tokens.encoder("word_bpe_49k.json").tok, 0
    got = run("op8")
    for d, t in sorted(rows):
        ids = np.array([*raw.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    pieces = collections.defaultdict(list)
    for r in q["op7"](spark, f"file://{tmp_path}").collect():
        pieces[r["doc_id"]].append(r)
    raw = tokens.encoder(VOCABULARY).tok
    for d, t in rows:
        ids, end = np.array([*raw.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (end, len(ids), zlib.crc32(ids[end : end + r["length"]].tobytes()))
            end += r["length"]
        assert end == len(ids)
