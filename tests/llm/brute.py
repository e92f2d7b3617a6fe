"""Plain versions of the corpus operators, for small inputs."""

import collections
import hashlib
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def lines(rows, min_chars=40, min_docs=5):
    """rows: (doc_id, text) -> sorted (doc_id, n_lines, n_dropped, kept)."""
    key = lambda x: x.strip(SPACES).translate(FOLD)
    held = collections.defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= min_chars:
                held[key(x)].add(d)
    out = []
    for d, t in rows:
        a = (t or "").split("\n")
        keep = [x for x in a if not (d is not None and len(held.get(key(x), ())) >= min_docs and d != max(held[key(x)]))]
        out.append((d, len(a), len(a) - len(keep), "\n".join(keep)))
    return out


def repeats(rows, n=200):
    """rows: (doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept)."""
    seen = collections.Counter()
    raw = [(d, (t or "").encode()) for d, t in rows]
    for _, b in raw:
        seen.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\x01" * n
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def components(rows, num=75, den=100):
    """rows: (doc_id, text) with a doc_id each -> {doc_id: (n_shingles, component)}."""
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}
