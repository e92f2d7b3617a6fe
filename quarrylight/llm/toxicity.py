"""Toxic spans by a linear-chain conditional random field.

Labels say which documents are toxic, not which words. So the tokens are labelled first: in the toxic documents of a
bounded sample, a word counts as toxic if it, or a beginning of it, stands in so many more toxic than clean documents that chance
is ruled out. A chain of two tags is then trained on those tokens - features are a word and its beginnings of 3 to 6 bytes, hashed; edges
are the four transitions - and run over every sentence of every text. The marginals of forward-backward give the
offending places, and their sums, put through a logistic curve fitted on the same sample, the document's score.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, need, without
from .kernels import U, chunks, mix, spell, text_sets, utf8_batch

TABLE = 1 << 22
BEGINNINGS = (3, 4, 5, 6)
#: Words of a sentence that form one chain; a longer sentence is several.
CHAIN = 64
#: A feature marks toxic words if chance would deal its documents so unevenly less often than exp(-EVIDENCE).
EVIDENCE = 10.0
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


@dataclass
class Model:
    """places of the features that have a weight, the upper bits of their hashes, by which others at a place are told from them, and the weights of tag 1."""

    places: np.ndarray
    checks: np.ndarray
    weights: np.ndarray
    bias: float
    edges: np.ndarray  # 2 x 2 potentials, logarithms
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)  # intercept, of log(1 + sum), of the largest marginal
    constant: float | None = None  # the score of every text, where there was nothing to learn
    notes: dict = field(default_factory=dict)

    def __post_init__(self):
        self.check, self.weight = np.zeros(TABLE, np.uint32), np.zeros(TABLE, np.float32)
        self.check[self.places], self.weight[self.places] = self.checks, self.weights

    def __reduce__(self):  # the tables are made anew where the model arrives
        return Model, (self.places, self.checks, self.weights, self.bias, self.edges, self.curve, self.constant, self.notes)


class Words:
    """The words of a chunk of texts: hashed features, place of each, and the chains they form.

    With check, a feature that another one of its place was learnt for is none (0).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, check: np.ndarray | None = None):
        self.starts, self.ends, values, first = spell(data, offsets)
        self.at = np.searchsorted(self.starts, offsets)
        n = len(self.starts)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        size = self.ends - self.starts
        self.features = np.zeros((1 + len(BEGINNINGS), n), np.int32)
        self.checks = np.zeros((1 + len(BEGINNINGS), n), np.uint32) if check is None else None
        self._place(0, slice(None), mix(total[first + size] - total[first] + size.astype(np.uint64)), check)
        for i, k in enumerate(BEGINNINGS, 1):
            run = size >= k
            s = first[run]
            f = mix((total[s + k] - total[s]) + U(k * 0x9E3779B97F4A7C15 % 2**64))
            self._place(i, run, f, check)  # elsewhere 0: the word is shorter
        # a chain ends with a text, with a sentence and after CHAIN words
        first = np.zeros(n, bool)
        if n:
            last = _STOP[data[self.ends - 1]]
            first[1:] = last[:-1]
            first[self.at[:-1][self.at[:-1] < n]] = True
            head = np.flatnonzero(first)
            since = np.arange(n) - np.repeat(head, np.diff(np.append(head, n)))
            first |= since % CHAIN == 0
        self.heads = np.flatnonzero(first)
        self.sizes = np.diff(np.append(self.heads, n))

    def _place(self, i: int, which, h: np.ndarray, check) -> None:
        at, upper = (h & U(TABLE - 1)).astype(np.int32), (h >> U(32)).astype(np.uint32) | np.uint32(1)
        if check is None:
            self.features[i, which], self.checks[i, which] = at, upper
        else:
            self.features[i, which] = np.where(check[at] == upper, at, 0)

    def emissions(self, m: Model) -> np.ndarray:
        e = np.full(self.features.shape[1], m.bias)
        for f in self.features:
            e += m.weight[f]
        return e


def groups(sizes: np.ndarray):
    """Chains by length, so that little is padded: rows of chain numbers of at most 8, 16, 32, ... words."""
    low, high = 0, 8
    while low < CHAIN:
        rows = np.flatnonzero((sizes > low) & (sizes <= high))
        if len(rows):
            yield rows, min(high, int(sizes[rows].max()))
        low, high = high, 2 * high


def forward_backward(e: np.ndarray, on: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """e, on: words x chains; emissions of tag 1 (tag 0 has 0) and whether there is a word. Marginals of tag 1, sums of pair marginals, log Z of each chain."""
    length, n = e.shape
    t = np.exp(edges)
    psi = np.exp(np.clip(e, -30, 30))
    a0, a1 = np.empty((length, n)), np.empty((length, n))
    scale = np.ones((length, n))
    for i in range(length):
        if i == 0:
            x0, x1 = np.ones(n), psi[0].copy()
        else:
            x0 = a0[i - 1] * t[0, 0] + a1[i - 1] * t[1, 0]
            x1 = (a0[i - 1] * t[0, 1] + a1[i - 1] * t[1, 1]) * psi[i]
        z = x0 + x1
        z[~on[i]] = 1.0
        if i:
            x0 = np.where(on[i], x0, a0[i - 1] * 1.0)
            x1 = np.where(on[i], x1, a1[i - 1] * 1.0)
        a0[i], a1[i], scale[i] = x0 / z, x1 / z, z
    b0, b1 = np.ones(n), np.ones(n)
    marginal = np.empty((length, n))
    pairs = np.zeros((2, 2))
    for i in range(length - 1, -1, -1):
        marginal[i] = a1[i] * b1 / (a0[i] * b0 + a1[i] * b1)
        if i:
            z = scale[i]
            f0, f1 = b0 / z, b1 * psi[i] / z
            live = on[i]
            p = a0[i - 1], a1[i - 1]
            for u in (0, 1):
                for v, f in ((0, f0), (1, f1)):
                    pairs[u, v] += (p[u] * t[u, v] * f)[live].sum()
            n0, n1 = t[0, 0] * f0 + t[0, 1] * f1, t[1, 0] * f0 + t[1, 1] * f1
            b0, b1 = np.where(live, n0, b0), np.where(live, n1, b1)
    return marginal, pairs, np.log(scale).sum(axis=0)


def marginals(w: Words, m: Model) -> np.ndarray:
    """The probability that each word is toxic."""
    e = w.emissions(m)
    out = np.zeros(len(e))
    for rows, length in groups(w.sizes):
        at = w.heads[rows][None, :] + np.arange(length)[:, None]
        on = np.arange(length)[:, None] < w.sizes[rows][None, :]
        at = np.where(on, at, 0)
        p, _, _ = forward_backward(np.where(on, e[at], 0.0), on, m.edges)
        out[at[on]] = p[on]
    return out


def _sums(w: Words, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the expected number of toxic words, as minus the sum of log(1 - p), and the largest p."""
    q = np.concatenate([[0.0], np.cumsum(-np.log1p(-np.minimum(p, 1 - 1e-9)))])
    total = q[w.at[1:]] - q[w.at[:-1]]
    most = np.zeros(len(w.at) - 1)
    some = np.flatnonzero(np.diff(w.at))
    if len(some):
        most[some] = np.maximum.reduceat(p, w.at[:-1][some])
    return total, most


def _curve(total, most, m: Model) -> np.ndarray:
    a, b, c = m.curve
    return 1 / (1 + np.exp(-(a + b * np.log1p(total) + c * most)))


def unlike(texts: pa.Array, most: float = 0.3) -> np.ndarray:
    """Places of the texts of which at most that share of the 5-word shingles stands in an earlier one: copies are no further evidence."""
    sets = list(text_sets(texts))
    sizes = np.array([len(s) for s in sets], np.int64)
    whose = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    h = np.concatenate([np.zeros(0, np.uint64), *sets])
    del sets
    order = np.argsort(h, kind="stable")
    h, whose = h[order], whose[order]
    seen = np.bincount(whose[1:][h[1:] == h[:-1]], minlength=len(sizes))
    return np.flatnonzero(seen <= most * np.maximum(sizes, 1))


def train(texts: pa.Array, labels: np.ndarray, class_sizes: tuple[int, int] = (0, 0), max_chains: int = 60_000, steps: int = 60, seed: int = 5) -> Model:
    """texts and their labels (0 or 1) in memory: the bounded sample. Near copies of earlier texts in it are left out.

    class_sizes: how many documents there are of label 0 and 1, which the curve is weighted back to. max_chains: beyond so many chains, they are drawn at random.
    """
    kept = unlike(texts)
    texts, labels = texts.take(pa.array(kept)), labels[kept]
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    none = np.zeros(0, np.int64)
    if not n1 or not n0:
        return Model(none, none, none, -5.0, np.zeros((2, 2)), constant=0.5 if not n1 + n0 else float(n1 > 0))
    data, off = utf8_batch(texts)
    spans = list(chunks(off))

    def parts(check=None):
        """The words of the texts, chunk by chunk and made anew each time, so that one chunk is held."""
        for a, b in spans:
            yield Words(data[off[a] : off[b]], off[a : b + 1] - off[a], check), labels[a:b]

    docs, check = np.zeros((2, TABLE), np.int32), np.zeros(TABLE, np.uint32)
    for value in (0, 1):  # where features share a place, it is a toxic text's
        for w, y in parts():
            whose = np.repeat(np.arange(len(y)), np.diff(w.at))
            mine = (y == value)[whose]
            for f, u in zip(w.features, w.checks):
                check[f[mine]] = u[mine]
                pair = np.unique(whose[mine].astype(np.int64) * TABLE + f[mine])
                np.add.at(docs[value], pair % TABLE, 1)
    seen = np.flatnonzero(docs[0] + docs[1] >= 2)
    seen = seen[seen > 0]
    t, both = docs[1, seen], docs[0, seen] + docs[1, seen]
    known = check[seen]
    check[:] = 0
    check[seen] = known
    del docs
    p0, x = n1 / (n1 + n0), t / both
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(x > 0, x * np.log(x / p0), 0) + np.where(x < 1, (1 - x) * np.log((1 - x) / (1 - p0)), 0)
    marks = np.zeros(TABLE, bool)
    marks[seen] = (x > max(0.7, p0)) & (both * kl >= EVIDENCE)
    # chains with a marked word, and twice as many others
    rng = np.random.default_rng(seed)
    e_at, gold = [], []
    for w, y in parts(check):
        tag = np.repeat(y == 1, np.diff(w.at)) & marks[w.features].any(axis=0)
        has = np.add.reduceat(tag, w.heads) > 0 if len(w.heads) else np.zeros(0, bool)
        others = np.flatnonzero(~has)
        pick = np.concatenate([np.flatnonzero(has), rng.permutation(others)[: 2 * int(has.sum()) + 50]])
        for r in pick.tolist():
            s, e = w.heads[r], w.heads[r] + w.sizes[r]
            e_at.append(w.features[:, s:e].copy())
            gold.append(tag[s:e])
    if not gold:  # no words at all
        return Model(none, none, none, -5.0, np.zeros((2, 2)), constant=n1 / (n1 + n0))
    order = rng.permutation(len(gold))[:max_chains]
    sizes = np.array([len(gold[i]) for i in order])
    heads = np.cumsum(sizes) - sizes
    feats, tags = np.concatenate([e_at[i] for i in order], axis=1), np.concatenate([gold[i] for i in order])
    del e_at, gold
    layout = []
    for rows, length in groups(sizes):
        at = heads[rows][None, :] + np.arange(length)[:, None]
        on = np.arange(length)[:, None] < sizes[rows][None, :]
        layout.append((np.where(on, at, 0), on))
    want = np.zeros((2, 2))
    inner = np.ones(len(tags), bool)
    inner[heads] = False
    i = np.flatnonzero(inner)
    np.add.at(want, (tags[i - 1].astype(int), tags[i].astype(int)), 1)
    used = np.unique(feats)
    used = used[used > 0]
    local = np.where(feats > 0, np.searchsorted(used, feats) + 1, 0)
    del feats
    theta = np.zeros(len(used) + 1 + 1 + 4)
    theta[len(used) + 1] = -2.0
    mom, var = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        wts, bias, edges = theta[: len(used) + 1], theta[len(used) + 1], theta[-4:].reshape(2, 2)
        e = bias + sum(wts[f] for f in local)
        p, pairs = np.zeros(len(tags)), np.zeros((2, 2))
        for at, on in layout:
            q, pr, _ = forward_backward(np.where(on, e[at], 0.0), on, edges)
            p[at[on]] = q[on]
            pairs += pr
        miss = tags - p
        grad = np.zeros_like(theta)
        for f in local:
            grad[: len(used) + 1] += np.bincount(f, miss, minlength=len(used) + 1)
        grad[0] = 0.0
        grad[len(used) + 1] = miss.sum()
        grad[-4:] = (want - pairs).ravel()
        grad -= 0.1 * theta
        mom, var = 0.9 * mom + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        theta += 0.3 * (mom / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-6)
    m = Model(used, check[used], theta[1 : len(used) + 1].copy(), float(theta[len(used) + 1]), theta[-4:].reshape(2, 2).copy())
    # the curve, on documents, with the sample's classes weighted back to their share
    got = [_sums(w, marginals(w, m)) for w, _ in parts(m.check)]
    x = np.stack([np.ones(len(labels)), np.log1p(np.concatenate([g[0] for g in got])), np.concatenate([g[1] for g in got])], axis=1)
    wt = np.where(labels == 1, max(class_sizes[1], n1) / n1, max(class_sizes[0], n0) / n0)
    wt = wt / wt.mean()
    b = np.zeros(3)
    ridge = np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (wt * s * (1 - s))[:, None]).T @ x + ridge
        d = np.linalg.solve(h, x.T @ (wt * (labels - s)) - ridge @ b)
        b += d
        if np.abs(d).max() < 1e-8:
            break
    m.curve = tuple(float(v) for v in b)
    m.notes = {"features": int(marks.sum()), "toxic": n1, "clean": n0, "tokens": int(len(tags))}
    return m


def held_out(doc_id: Column) -> Column:
    """Rows from whose labels nothing is learnt: crc32 of the id as text, mod 3, is 1. False without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _train(class_sizes: tuple[int, int], max_chains: int):
    """All rows (text, toxic) of one task -> one row, the model."""

    def f(batches):
        batches = list(batches)
        t = pa.Table.from_batches(batches) if batches else None
        text = pa.concat_arrays([c.cast(pa.large_string()) for c in t.column("text").chunks]) if t else pa.array([], pa.large_string())
        y = np.asarray(t.column("toxic").to_numpy(), np.int64) if t else np.zeros(0, np.int64)
        model = pickle.dumps(train(text, y, class_sizes, max_chains))
        del t, text, batches
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    return f


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = 2000, max_clean: int = 6000, max_chains: int = 60_000) -> Model:
    """Train on the whole texts of at most max_toxic and max_clean labelled documents, the first ones by a hash of their id, and on at most max_chains of their chains.

    labels: doc_id, toxic. A document that is labelled more than once is toxic if one of its labels says so; null labels
    are left out. Only rows that are not held out are learnt from. Documents whose class has none give a constant score.
    One executor task trains; only the model, of at most TABLE weights, reaches the driver.
    """
    need(docs, "doc_id", "text")
    need(labels, "doc_id", "toxic")
    known = labels.filter("toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    size = {r["toxic"]: r["n"] for r in known.filter("toxic in (0, 1)").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pick = None
    for value, most in ((1, max_toxic), (0, max_clean)):
        part = known.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        pick = part if pick is None else pick.union(part)
    rows = docs.select("doc_id", "text").join(pick.hint("broadcast"), "doc_id")  # at most max_toxic + max_clean ids
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(max_toxic + max_clean).select("text", "toxic")  # one task
    got = rows.mapInArrow(_train((size.get(0, 0), size.get(1, 0)), max_chains), "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else train(pa.array([], pa.string()), np.zeros(0, np.int64))


SPANS = "array<struct<start: bigint, end: bigint, p: double>>"


def _spans(data: np.ndarray, off: np.ndarray, w: Words, p: np.ndarray, least: float) -> list[list[dict]]:
    """Runs of words that are likelier toxic than not, as code points of the text."""
    hit = np.flatnonzero(p >= least)
    out: list[list[dict]] = [[] for _ in range(len(off) - 1)]
    if not len(hit):
        return out
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    whose = np.searchsorted(w.at, hit, side="right") - 1
    for i, d in zip(hit.tolist(), whose.tolist()):
        s, e = int(chars[w.starts[i]] - chars[off[d]]), int(chars[w.ends[i]] - chars[off[d]])
        if out[d] and out[d][-1]["word"] == i - 1:
            out[d][-1].update(word=i, end=e, p=max(out[d][-1]["p"], float(p[i])))
        else:
            out[d].append({"word": i, "start": s, "end": e, "p": float(p[i])})
    return [[{k: x[k] for k in ("start", "end", "p")} for x in d] for d in out]


def _score(m: Model, spans: bool):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def f(batches):
        for batch in batches:
            whole = batch.num_columns == 1  # rows as they are, the text within
            data, off = utf8_batch(batch.column(0).field("text") if whole else batch.column(1))
            for a, b in chunks(off):
                d, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
                if m.constant is not None:
                    score, found = np.full(b - a, m.constant), [[]] * (b - a)
                else:
                    w = Words(d, o, m.check)
                    p = marginals(w, m)
                    score = _curve(*_sums(w, p), m)
                    found = _spans(d, o, w, p, 0.5) if spans else [[]] * (b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score), pa.array(found, kind)], names=["doc_id", "score", "spans"])
        give_back()

    return f


def score_documents(docs: DataFrame, model: Model, spans: bool = True, carry: bool = False) -> DataFrame:
    """doc_id, score (0 to 1), spans (start, end in code points; p) of every row of docs (doc_id, text).

    Other columns are left out; with carry all of docs' columns are kept as they are, and score and spans replace those of these names.

    A null or empty text has no spans and the score of a text without toxic words. Rows with a null or repeated doc_id
    are scored each by its own text. An empty table gives an empty result.
    """
    need(docs, "doc_id", "text")
    if not carry:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        return rows.mapInArrow(_score(model, spans), f"doc_id long, score double, spans {SPANS}")
    rows = without(docs, "score", "spans")
    rows = rows.select(F.struct(*[rows[f"`{c}`"] for c in rows.columns]).alias("doc_id"))
    kind = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("spans", T._parse_datatype_string(SPANS))])
    out = rows.mapInArrow(_score(model, spans), kind)
    return out.select("doc_id.*", "score", "spans")
