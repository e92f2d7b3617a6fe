"""Encoding of whole texts with the tokenizers library, a cache of units in front of it.

Both kinds of vocabulary cut a text before each run of white space, whatever stands around it, so what single spaces and
line feeds part encodes on its own, and most of it has been met before. A text for which that does not hold (two white
spaces on end, another kind of vocabulary) is given to the library whole. The ids equal the library's own.
"""

from __future__ import annotations

import json
import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Units that a worker keeps; the cache starts anew when it is full.
CACHE = 1_200_000
#: Characters that are cut into pieces at a time.
CHUNK = 1 << 20

_encoders: dict[tuple, "Encoder"] = {}


def vocabulary_path(name: str) -> str:
    """Where a vocabulary file of the public tokenizers lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encoder(path: str, plain_specials: bool = False) -> "Encoder":
    """This worker's encoder; path: a file, or the name of a public vocabulary."""
    key = (path, plain_specials)
    if key not in _encoders:
        _encoders[key] = Encoder(path if os.path.exists(path) else vocabulary_path(path), plain_specials)
    return _encoders[key]


class Encoder:
    def __init__(self, path: str, plain_specials: bool = False, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.cache = Tokenizer.from_file(path), cache
        self.tok.encode_special_tokens = plain_specials
        with open(path) as f:
            spec = json.load(f)
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        steps = [p["type"] for p in pre.get("pretokenizers", [])]
        self.spaced = pre.get("type") == "ByteLevel" and norm is None and pre["use_regex"] and not pre["add_prefix_space"]
        self.split = bool(norm) and steps == ["Split", "ByteLevel"] and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        # many units are encoded as one text, parted by what always is one id of its own
        self.part = "\n" if self.spaced else " | "
        self.part_id = self._raw([self.part])[0][0]
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> None:
        """A unit's key is the piece: after a space stands at the head of a text, after a line feed at that of a line, the others follow a space."""
        texts = [u[1:] if u[:1] == " " else u if u[:1] == "\n" else f" {u}" for u in units] if self.spaced else units
        mark = self.part.strip(" ")
        plain = [bool(x.strip()) and not (mark in x or "<" in x) for x in texts]
        order = [i for i, p in enumerate(plain) if p]
        runs = [order[i : i + 2000] for i in range(0, len(order), 2000)]
        flat, sizes = [], []
        for e in self._raw([self.part.join(texts[i] for i in r) + self.part for r in runs]):
            e = np.array(e, np.uint32)
            cut = np.flatnonzero(e == self.part_id)
            sizes.append(np.diff(cut, prepend=-1) - 1)
            flat.append(np.delete(e, cut))
        odd = [i for i, p in enumerate(plain) if not p]  # those with the mark, or perhaps a special token, in them
        rest = self._raw([texts[i] for i in odd])
        sizes.append(np.fromiter(map(len, rest), np.int64, len(rest)))
        flat.append(np.fromiter((i for x in rest for i in x), np.uint32))
        sizes, flat = np.concatenate(sizes), np.concatenate(flat)
        units = [units[i] for i in order + odd]
        n, m = len(self.at), len(self.at) + len(units)
        while m > len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start * 0]), np.concatenate([self.size, self.size * 0])
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat * 0])
        self.size[n:m] = sizes
        self.start[n:m] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + total] = flat
        self.used += total
        self.at.update(zip(units, range(n, m)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, uint32."""
        if not (self.spaced or self.split):
            return [np.array(x, np.uint32) for x in self._raw(texts)]
        out: list = [None] * len(texts)
        units: list[str] = []
        whose, ends = [], []
        for i, t in enumerate(texts):
            if not self.spaced:
                p = t.replace("\n", " ").split(" ")
            elif " ".join(t.split()) == t.replace("\n", " "):
                p = t.replace("\n", " \n").split(" ")
                p[0] = f" {p[0]}"
            else:  # other white space, or two on end
                out[i] = np.array(self._raw([t])[0], np.uint32)
                continue
            units += p
            whose.append(i)
            ends.append(len(units))
        if len(self.at) > self.cache:
            self._clear()
        at = np.fromiter(map(self.at.get, units, repeat(-1)), np.int64, len(units))
        if len(new := np.flatnonzero(at < 0)):
            new = new.tolist()
            self._learn(list({units[i] for i in new}))
            at[new] = [self.at[units[i]] for i in new]
        size = self.size[at]
        end = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[at] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
        a = 0
        for i, e in zip(whose, ends):
            b = int(end[e - 1])
            out[i] = ids[a:b]
            a = b
        return out

    def batches(self, texts: pa.Array, chunk: int = CHUNK):
        """encode() over an Arrow array, so many bytes at a time; a null is an empty text."""
        sizes = np.asarray(pa.compute.binary_length(texts.cast(pa.large_string())).fill_null(0))
        a, n = 0, len(texts)
        total = np.concatenate([[0], np.cumsum(sizes)])
        while a < n:
            b = min(n, max(a + 1, int(np.searchsorted(total, total[a] + chunk, side="right")) - 1))
            yield a, self.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
            a = b
