"""Vectorised kernels over batches of texts: words, word hashes, 5-word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
WORDS = 5
#: Bytes of text that are hashed at a time; a longer text is hashed on its own.
CHUNK = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z hash as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = U(0x9E3779B97F4A7C15)
_INV = U(pow(int(_BASE), -1, 2**64))
_PLACE = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * U(2) + U(1)
_SHORT = U(0xD1B54A32D192ED03)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, CHUNK + 1024), base, dtype=np.uint64)
        p[0] = 1
        have = np.cumprod(p, dtype=np.uint64)
        if n > 4 * CHUNK:
            return have  # not kept for one very long text
        _powers[name] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def utf8_batch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and n + 1 offsets; a null is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most size bytes together, or one text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def _places(n: int) -> np.ndarray:
    """An odd multiplier for each of n places of a word."""
    have = _powers.get("places")
    if have is None or len(have) < n:
        have = mix(np.arange(1, max(n, 256) + 1, dtype=np.uint64) * _BASE) | U(1)
        if n <= CHUNK:  # not kept for one very long word
            _powers["places"] = have
    return have


def spell(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: each word's first place and the one after its last; a value for every byte of a word, on end, and each word's first place among these.

    A byte's value depends on the byte (A-Z as a-z) and its place in the word, by unrelated multipliers: sums of values tell words apart,
    also words of much alike structure, for which powers of one base cancel out.
    """
    n = len(data)
    black = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = black.copy(), black.copy()
    if n:
        first[1:] &= ~black[:-1] | edge[1:n]
        last[:-1] &= ~black[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sizes = ends - starts
    at = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
    values = _BYTE[data[black]] * _places(int(sizes.max()) if len(sizes) else 0)[place]
    return starts, ends, values, at


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: a 64-bit hash of every word (A-Z as a-z), its first byte's place, and n + 1 offsets of the texts' words."""
    starts, ends, values, at = spell(data, offsets)
    h = np.add.reduceat(values, at) if len(at) else np.zeros(0, np.uint64)
    h = mix(h + (ends - starts).astype(np.uint64) * _SHORT)
    return h, starts, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, at: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of each text (not yet distinct) and n + 1 offsets. A text of 1 to size - 1 words has one, of all its words."""
    count = np.diff(at)
    n = len(words)
    full = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        if len(full):
            full += words[k : n - size + 1 + k] * _PLACE[k]
    full = mix(full)
    out_n = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    off = np.concatenate([[0], np.cumsum(out_n)])
    out = np.empty(off[-1], np.uint64)
    long = count >= size
    keep = np.zeros(n + 1, np.int32)
    np.add.at(keep, at[:-1][long], 1)
    np.add.at(keep, at[1:][long] - size + 1, -1)
    keep = np.cumsum(keep)[: len(full)] > 0
    place = np.repeat(long, out_n)
    out[place] = full[keep]
    for i in np.flatnonzero((count > 0) & ~long):
        w = words[at[i] : at[i + 1]]
        out[off[i]] = mix((w * _PLACE[: len(w)]).sum(dtype=np.uint64, keepdims=True) + U(len(w) * int(_SHORT) % 2**64))[0]
    return out, off


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a chunk."""
    w, _, at = word_hashes(data, offsets)
    h, off = shingles(w, at, size)
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        s = np.sort(h[a:b])
        if len(s) > 1:
            first = np.empty(len(s), bool)
            first[0] = True
            np.not_equal(s[1:], s[:-1], out=first[1:])
            s = s[first]
        out.append(s)
    return out


def text_sets(texts: pa.Array, size: int = WORDS) -> Iterator[np.ndarray]:
    """shingle_sets of every text of an array, chunk by chunk."""
    data, off = utf8_batch(texts)
    for a, b in chunks(off):
        yield from shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], size)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted distinct arrays share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
