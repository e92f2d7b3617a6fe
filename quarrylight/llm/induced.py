"""External induced sorting: which strings of a given length start more than once in a text.

Suffixes are sorted by induction. The suffixes at the leftmost places of ascending runs (the sample) are named by the
substring that leads to the next of them; the names form a shorter text, which is sorted by the same induction, or
directly once it fits in memory. From the sorted sample every other suffix is induced: a scan in ascending order yields
the descending ones, a scan in descending order the others. What a scan induces waits in a priority queue whose key is
(first symbol, rank of the inducing suffix) until the scan reaches it; as ranks only grow during a scan, the queue is
one first-in first-out list a symbol, held in memory up to a budget and on disk beyond it. With each suffix goes the length of
the prefix it shares with its predecessor: 1 + the least such length between the two inducing suffixes. Lengths are
capped at the length asked for, and order is only needed to that depth.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Names that are sorted directly, in memory; more are sorted by induction.
BASE = 4_000_000
#: Entries of a queue that are held in memory.
MEMORY = 32_000_000


class DiskQueue:
    """Lists of (place, shared prefix), one a symbol; beyond a budget what waits goes to a file."""

    def __init__(self, memory: int = MEMORY, folder: str | None = None):
        self.memory, self.folder = memory, folder
        self.lists: dict[int, list] = {}
        self.held, self.file, self.spilled = 0, None, 0

    def push(self, symbol: int, place: np.ndarray, shared: np.ndarray) -> None:
        self.lists.setdefault(symbol, []).append((place, shared))
        self.held += len(place)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=self.folder)
        self.file.seek(0, 2)
        for parts in self.lists.values():
            for i, p in enumerate(parts):
                if not isinstance(p[0], int):
                    at = self.file.tell()
                    self.file.write(p[0].astype(np.int64).tobytes())
                    self.file.write(p[1].tobytes())
                    parts[i] = (at, len(p[0]))
                    self.spilled += len(p[0])
        self.held = 0

    def pop(self, symbol: int):
        """All that waits under a symbol, in the order in which it came."""
        parts = self.lists.pop(symbol, [])
        if not parts:
            return None
        places, shared = [], []
        for a, b in parts:
            if isinstance(a, int):
                self.file.seek(a)
                places.append(np.frombuffer(self.file.read(8 * b), np.int64))
                shared.append(np.frombuffer(self.file.read(b), np.uint8))
            else:
                places.append(a)
                shared.append(b)
                self.held -= len(a)
        return np.concatenate(places), np.concatenate(shared)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def ascending(t: np.ndarray) -> np.ndarray:
    """For each place whether its suffix is smaller than the next one. t ends with its only 0."""
    n = len(t)
    up = np.ones(n, bool)
    kind = np.int32 if n < 1 << 31 else np.int64
    last = np.where(t[1:] != t[:-1], np.arange(n - 1, dtype=kind), kind(n))
    nearest = np.minimum.accumulate(last[::-1])[::-1]  # the next place whose successor differs
    up[:-1] = (t[1:] > t[:-1])[nearest]
    return up


def _words(t: np.ndarray, at: np.ndarray, bits: int, per: int) -> np.ndarray:
    """per symbols from each place, packed in order."""
    w = np.zeros(len(at), np.uint64)
    n = len(t)
    for k in range(per):
        i = at + k
        w = (w << np.uint64(bits)) | np.where(i < n, t[np.minimum(i, n - 1)], 0).astype(np.uint64)
    return w


def _refine(rank: np.ndarray, rows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Split the groups of equal rank among rows by key; returns the rows whose group still has several members."""
    old = rank[rows]
    span = int(key.max()) + 1 if len(key) else 1
    if not old.any():
        order = np.argsort(key)
    elif key.dtype.kind == "i" and key.min() >= 0 and int(old.max() + 1) * span < 1 << 62:
        order = np.argsort(old * span + key)
    else:
        order = np.lexsort((key, old))
    rows, key = rows[order], key[order]
    r = rank[rows]
    new_group = np.concatenate([[True], r[1:] != r[:-1]])
    new_key = new_group | np.concatenate([[True], key[1:] != key[:-1]])
    at = np.arange(len(rows))
    start = np.maximum.accumulate(np.where(new_group, at, 0))
    mine = np.maximum.accumulate(np.where(new_key, at, 0))
    rank[rows] = r + (mine - start)
    alone = new_key & np.concatenate([new_key[1:], [True]])
    return rows[~alone]


def sort_sample(t: np.ndarray, sample: np.ndarray, cap: int, base: int, memory: int, folder) -> np.ndarray:
    """The sample's places in the order of their suffixes, to a depth of cap symbols at least."""
    n = len(sample)
    if n <= 1:
        return sample
    bits = max(1, int(t.max()).bit_length())
    per = max(1, 63 // bits)
    size = np.diff(np.append(sample, len(t) - 1)) + 1
    rank = np.zeros(n, np.int64)
    rows = np.arange(n)
    depth = 0
    while len(rows) and depth <= cap:
        rows = _refine(rank, rows, _words(t, sample[rows] + depth, bits, per))
        depth += per
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, rank[rows], size[rows])
        rows = rows[longest[rank[rows]] > depth]
    tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    if len(tied):
        tied = _refine(rank, tied, size.max() - size[tied])  # equal symbols: the longer one goes on to descend
    if n > base and len(tied):
        _, names = np.unique(rank, return_inverse=True)
        names = np.append(names + 1, 0)
        order = induced_order(names, cap, base, memory, folder)
        return sample[order[order < n]]
    h = 1
    while len(tied) and 2 * h < 2 * cap:  # a name is two symbols at least
        nxt = tied + h
        tied = _refine(rank, tied, np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0))
        h *= 2
    return sample[np.argsort(rank, kind="stable")]


def shared_prefixes(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Lengths of the common prefixes of suffixes, up to cap."""
    out = np.zeros(len(a), np.uint8)
    t = np.concatenate([t, np.zeros(cap + 16, t.dtype)])
    rows, depth, step = np.arange(len(a)), 0, 16
    if t.dtype == np.uint16:  # four symbols at a time, as most pairs part early
        four = np.lib.stride_tricks.as_strided(t.view(np.uint8)[: 8 * (len(t) // 4)].view(np.uint64), shape=(len(t) - 3,), strides=(2,))
        while len(rows) and depth < min(16, cap):
            x = four[a[rows] + depth] ^ four[b[rows] + depth]
            same = np.full(len(x), 4)
            for k in (3, 2, 1, 0):
                same[(x >> np.uint64(16 * k)) & np.uint64(0xFFFF) != 0] = k
            out[rows] = np.minimum(cap, depth + same)
            rows, depth = rows[x == 0], depth + 4
    while len(rows) and depth < cap:
        w = np.arange(depth, depth + step)
        differ = t[a[rows, None] + w] != t[b[rows, None] + w]
        some = differ.any(axis=1)
        out[rows] = np.minimum(cap, depth + np.where(some, differ.argmax(axis=1), step))
        rows, depth = rows[~some], depth + step
    return out


def _run(t: np.ndarray, i: int, cap: int) -> int:
    w = t[i : i + cap]
    other = np.flatnonzero(w != t[i])
    return int(other[0]) if len(other) else len(w)


class _Scan:
    """What a scan has seen since it last induced into each symbol."""

    def __init__(self, t, wanted, queue, cap, lengths):
        self.t, self.wanted, self.queue, self.cap, self.lengths = t, wanted, queue, cap, lengths
        sigma = int(t.max()) + 1 if lengths else 0
        self.least = np.full(sigma, min(cap, 255), np.uint8)
        self.begun = np.zeros(sigma, bool)

    def induce(self, place: np.ndarray, shared: np.ndarray) -> None:
        """place: the next suffixes of the scan; shared: with the one scanned before."""
        before = np.maximum(place - 1, 0)
        k = np.flatnonzero((place > 0) & self.wanted[before])
        target = self.t[before[k]]
        order = np.argsort(target, kind="stable")
        k, target = k[order], target[order]
        edges = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(k) else np.zeros(0, np.int64)
        if self.lengths:
            self_least = np.minimum(self.least, shared.min())
        for a, b in zip(edges.tolist(), np.append(edges[1:], len(k)).tolist()):
            s, at = int(target[a]), k[a:b]
            if self.lengths:
                cut = np.concatenate([[0], at + 1])
                tail = self.cap
                if cut[-1] == len(shared):
                    low = np.minimum.reduceat(shared, cut[:-1])
                else:
                    low = np.minimum.reduceat(shared, cut)
                    low, tail = low[:-1], low[-1]
                low[0] = min(low[0], self.least[s])
                got = np.minimum(low, self.cap - 1) + np.uint8(1)
                if not self.begun[s]:
                    got[0], self.begun[s] = 0, True
                self_least[s] = tail
            else:
                got = np.zeros(len(at), np.uint8)
            self.queue.push(s, place[at] - 1, got)
        if self.lengths:
            self.least = self_least


def _induce_all(t, cap, base, memory, folder, lengths):
    """Yields (symbol, places, shared, seam): ascending symbols reversed; each symbol's suffixes as (descending part, ascending part)."""
    up = ascending(t)
    n = len(t)
    sample = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    ordered = sort_sample(t, sample[:-1] if len(sample) and sample[-1] == n - 1 else sample, cap, base, memory, folder)
    common = np.zeros(len(ordered), np.uint8)
    if lengths and len(ordered) > 1:
        common[1:] = shared_prefixes(t, ordered[1:], ordered[:-1], cap)
    head = t[ordered]
    symbols = np.unique(t)
    first = np.searchsorted(head, symbols)
    last = np.searchsorted(head, symbols, side="right")

    down_queue = DiskQueue(memory, folder)
    scan = _Scan(t, ~up, down_queue, cap, lengths)
    kept: list = []
    none = np.zeros(0, np.int64), np.zeros(0, np.uint8)
    scan.induce(np.array([n - 1]), np.zeros(1, np.uint8))
    store = DiskQueue(memory, folder)
    for c, a, b in zip(symbols.tolist(), first.tolist(), last.tolist()):
        tail = None
        while (block := down_queue.pop(c)) is not None:
            scan.induce(*block)
            store.push(c, *block)
            tail = int(block[0][-1])
        if b > a:
            lead, lens = ordered[a:b], common[a:b].copy()
            lens[0] = min(_run(t, tail, cap), _run(t, int(lead[0]), cap), cap) if tail is not None and lengths else 0
            scan.induce(lead, lens)
    down_queue.close()

    up_queue = DiskQueue(memory, folder)
    scan = _Scan(t, up, up_queue, cap, lengths)
    for c in symbols[::-1].tolist():
        parts, lens = [], []
        while (block := up_queue.pop(c)) is not None:
            scan.induce(*block)
            parts.append(block[0])
            lens.append(block[1])
        ups = (np.concatenate(parts), np.concatenate(lens)) if parts else none
        downs = store.pop(c) or none
        seam = 0
        if len(downs[0]):
            back = downs[0][::-1]
            shared = np.empty(len(back), np.uint8)
            shared[1:] = downs[1][::-1][:-1]
            if len(ups[0]) and lengths:
                seam = min(_run(t, int(ups[0][-1]), cap), _run(t, int(back[0]), cap), cap)
            shared[0] = seam
            scan.induce(back, shared)
        yield c, downs, ups, seam
    up_queue.close()
    store.close()


def induced_order(t: np.ndarray, cap: int, base: int = BASE, memory: int = MEMORY, folder=None) -> np.ndarray:
    """The suffix array of t (which ends with its only 0), to a depth of cap symbols at least."""
    parts = [(np.concatenate([downs[0], ups[0][::-1]])) for _, downs, ups, _ in _induce_all(t, cap, base, memory, folder, False)]
    return np.concatenate([np.array([len(t) - 1]), *parts[::-1]])


def repeated_starts(t: np.ndarray, length: int, base: int = BASE, memory: int = MEMORY, folder=None) -> np.ndarray:
    """For each place of t whether the string of that length that starts there also starts elsewhere.

    t ends with its only 0; separators between texts may repeat: a string with one in it is for the caller to leave out. length: at most 255.
    """
    out = np.zeros(len(t), bool)
    if len(t) <= length:
        return out
    for _, downs, ups, seam in _induce_all(t, length, base, memory, folder, True):
        for place, shared in (downs, ups):
            hit = shared >= length
            if len(hit):
                hit[0] = False  # the first of a part is compared at the seam
                out[place[hit]] = True
                out[place[np.flatnonzero(hit) - 1]] = True
        if seam >= length:
            out[downs[0][-1]] = out[ups[0][-1]] = True
    return out
