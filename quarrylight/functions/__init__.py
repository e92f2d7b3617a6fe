"""Scalar expressions over text, time and numbers; columns in, columns out, JVM-side unless the docstring says otherwise."""

from __future__ import annotations

import hashlib
import hmac as _hmac
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Punctuation before which no space stands (CJK marks).
CJK_MARKS = "，。；：、！？）】》"
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def normalize_block(c: Column) -> Column:
    """No NULs, runs of blanks as one space, line feeds as spaces, no space before a CJK mark, trimmed (SCA-01)."""
    c = F.regexp_replace(c, "\\x00", "")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r" ?\r?\n ?", " ")
    c = F.regexp_replace(c, f" +([{CJK_MARKS}])", "$1")
    return F.trim(c)


def blocks(c: Column) -> Column:
    """Paragraphs: what blank lines part (SCA-02)."""
    return F.split(c, r"\n\s*\n")


def meaningful_characters(c: Column, pattern: str = r"[\p{IsHan}A-Za-z0-9]") -> Column:
    """Count of Han characters, ASCII letters and digits (SCA-03); pass [\\p{L}\\p{N}] for all letters and digits."""
    return F.regexp_count(c, F.lit(pattern))


def dense_length(c: Column) -> Column:
    """Characters that are not white space (SCA-04)."""
    return F.length(F.regexp_replace(c, r"\s", ""))


def quoted(c: Column) -> Column:
    """A pattern that matches just this text."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def exact_count(text: Column, surface) -> Column:
    """Non-overlapping occurrences; an empty surface has none (SCA-05)."""
    s = lit(surface)
    n = F.length(s)
    return F.when(n > 0, ((F.length(text) - F.length(F.replace(text, s, F.lit("")))) / n).cast("int")).otherwise(F.lit(0))


def spaceless_count(text: Column, surface) -> Column:
    """exact_count where white space in the text is ignored."""
    return exact_count(F.regexp_replace(text, r"\s", ""), surface)


def occurrence_starts(text: Column, surface) -> Column:
    """0-based starts of the non-overlapping occurrences, left to right (SCA-06): lengths of the pieces between them, summed up."""
    s = lit(surface)
    pieces = F.split(text, quoted(s), -1)
    n = F.length(s)
    sums = F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, p: F.struct((acc["at"] + F.length(p) + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + F.length(p))).alias("starts")),
    )
    return F.when(n > 0, sums["starts"]).otherwise(F.array().cast("array<int>"))


def excerpt(text: Column, start: Column, length: Column, before: int = 72, after: int = 168) -> Column:
    """A window around a match, with ellipses where it is cut (SCA-07)."""
    a = F.greatest(F.lit(0), start - before)
    b = F.least(F.length(text), start + length + after)
    return F.concat(F.when(a > 0, F.lit("…")).otherwise(F.lit("")), F.substring(text, a + 1, b - a), F.when(b < F.length(text), F.lit("…")).otherwise(F.lit("")))


def first_year(*cs: Column, centuries: str = "19|20") -> Column:
    """The first year of the given centuries in the first argument that has one (SCA-08)."""
    found = [F.nullif(F.regexp_extract(c, rf"(?:^|[^0-9])((?:{centuries})[0-9]{{2}})(?:[^0-9]|$)", 1), F.lit("")) for c in cs]
    return F.coalesce(*found).cast("int") if len(found) > 1 else found[0].cast("int")


def last_year(c: Column, centuries: str = "18|19|20") -> Column:
    """The greatest year in a text (SCA-08)."""
    return F.array_max(F.transform(F.regexp_extract_all(c, F.lit(rf"\b((?:{centuries})[0-9]{{2}})\b"), F.lit(1)), lambda y: y.cast("int")))


def prioritized(*choices: tuple[str, Column]) -> tuple[Column, Column]:
    """The first value that is not null, and the name of its basis; 'unknown' if there is none (SCA-10)."""
    value = F.coalesce(*[c for _, c in choices])
    basis = F.lit("unknown")
    for name, c in reversed(choices):
        basis = F.when(c.isNotNull(), F.lit(name)).otherwise(basis)
    return value, basis


def classify(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that matches (SCA-11)."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def strip_html(c: Column) -> Column:
    """Text of a page: no script or style, tags as line feeds, five entities, at most one blank line on end (SRC-09)."""
    c = F.regexp_replace(c, r"(?is)<script\b.*?</script>", "")
    c = F.regexp_replace(c, r"(?is)<style\b.*?</style>", "")
    c = F.regexp_replace(c, r"<[^>]+>", "\n")
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\s*\n\s*\n\s*", "\n\n")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def numbers_in(c: Column) -> Column:
    """The numbers of a text, in order (SCA-16)."""
    return F.regexp_extract_all(c, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1))


def contains_either_way(a: Column, b: Column) -> Column:
    """Headings count as equal if one holds the other (SCA-16)."""
    return a.contains(b) | b.contains(a)


def agreement(a: Column, b: Column, digits: int = 4) -> Column:
    """1 - edit distance / length of the longer (SCA-17)."""
    return F.round(1 - F.levenshtein(a, b) / F.greatest(F.lit(1), F.length(a), F.length(b)), digits)


#: Characters of a text that its grams are taken from at a time: a place in a text is found by counting from its start.
PIECE = 256


def grams(c: Column, n: int = 3) -> Column:
    """All n-grams of characters, overlapping, in order; none in a shorter text. The text is cut into pieces, which overlap by n - 1, and each is bound before its grams are taken."""
    def of(x: Column) -> Column:
        return F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substring(x, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    def pieces(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1)), F.lit(PIECE)), lambda i: F.substring(x, i, F.lit(PIECE + n - 1)))

    return F.flatten(F.transform(F.flatten(F.transform(F.array(c), pieces)), of))


def bound(c: Column, f) -> Column:
    """f of a value that is evaluated once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def shared(x: Column, y: Column) -> Column:
    """Size of the intersection of two sorted arrays of strings as multisets, in one pass over both laid on end and sorted."""
    def marked(c: Column, right: bool) -> Column:
        return F.transform(c, lambda g: F.struct(g.alias("g"), F.lit(right).alias("right")))

    def step(acc: Column, e: Column) -> Column:
        spare = F.when(acc["g"] == e["g"], acc["spare"]).otherwise(0)  # of the left side's, not yet met
        return F.struct(e["g"].alias("g"), F.when(e["right"], F.greatest(spare - 1, F.lit(0))).otherwise(spare + 1).alias("spare"), (acc["n"] + (e["right"] & (spare > 0)).cast("int")).alias("n"))

    zero = F.struct(F.lit("").alias("g"), F.lit(0).alias("spare"), F.lit(0).alias("n"))
    return F.aggregate(F.sort_array(F.concat(marked(x, False), marked(y, True))), zero, step)["n"]


def dice(a: Column, b: Column, n: int = 3) -> Column:
    """Dice coefficient of the multisets of n-grams; 1 if both are empty, equality if both are shorter than n (SCA-18).

    The overlap is that of the distinct grams, by hash, and that of what each side has of a gram beyond the first, mostly little. Equal texts need no grams.
    """
    def again(g: Column) -> Column:
        return F.filter(g, lambda x, i: (i > 0) & (x == F.get(g, i - 1)))

    def overlap(g: Column) -> Column:
        return F.size(F.array_intersect(g["a"], g["b"])) + shared(again(g["a"]), again(g["b"]))

    def of(t: Column) -> Column:
        total = sum(F.greatest(F.length(t[c]) - (n - 1), F.lit(0)) for c in "ab")
        short = (F.length(t["a"]) < n) & (F.length(t["b"]) < n)
        both = F.struct(*[F.sort_array(grams(t[c], n)).alias(c) for c in "ab"])
        return F.when(t["a"] == t["b"], 1.0).when(short, 0.0).otherwise(F.round(2 * bound(both, overlap) / total, 4))

    return bound(F.struct(a.alias("a"), b.alias("b")), of)


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of a text's UTF-8 bytes (SCA-22)."""
    codes = F.transform(F.regexp_extract_all(F.hex(c.cast("binary")), F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, b: h.bitwiseXOR(b) * 16777619 % 4294967296)


def interpolate(x: Column, anchors: list[tuple[float, float]]) -> Column:
    """Piecewise linear through anchors of ascending x, constant beyond the ends (SCA-23)."""
    out = F.lit(float(anchors[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(anchors, anchors[1:]))):
        out = F.when(x <= x1, y0 + (x - x0) * (y1 - y0) / (x1 - x0)).otherwise(out)
    return F.when(x <= anchors[0][0], F.lit(float(anchors[0][1]))).otherwise(out)


def project(x: Column, y: Column, z: Column, yaw: float, pitch: float, focus: float = 930.0, near: float = 360.0) -> tuple[Column, Column, Column]:
    """Rotate about two axes and project: screen x, screen y, scale (SCA-24). Focus 930, near 360."""
    x1 = x * F.cos(F.lit(yaw)) - z * F.sin(F.lit(yaw))
    z1 = x * F.sin(F.lit(yaw)) + z * F.cos(F.lit(yaw))
    y1 = y * F.cos(F.lit(pitch)) - z1 * F.sin(F.lit(pitch))
    z2 = y * F.sin(F.lit(pitch)) + z1 * F.cos(F.lit(pitch))
    scale = F.lit(focus) / F.greatest(F.lit(near), focus + z2)
    return x1 * scale, y1 * scale, scale


def root_strength(rate: Column, top: Column, low: float = 0.28, high: float = 0.72) -> Column:
    """0.28 + 0.72 * sqrt(rate / max), fixed values (SCA-25, AGG-15)."""
    return F.round(low + high * F.sqrt(rate / top), 4)


def log_strength(n: Column, base: float, step: float, cap: float) -> Column:
    """min(cap, base + step * log2(n + 1)) (SCA-25)."""
    return F.round(F.least(F.lit(cap), base + step * F.log2(n + 1)), 4)


def window_start(ts: Column, seconds: int) -> Column:
    """Epoch-aligned start of the window of a time, as epoch seconds (SCA-26)."""
    return (F.floor(F.unix_timestamp(ts) / seconds) * seconds).cast("long")


def age_seconds(now: Column, ts: Column) -> Column:
    """Seconds since ts; infinite if it is null (SCA-27)."""
    return F.coalesce((F.unix_timestamp(now) - F.unix_timestamp(ts)).cast("double"), F.lit(float("inf")))


def compact_id(*parts: Column, length: int = 24, sep: str = "|") -> Column:
    """The first characters of the SHA-256 of the parts joined by a pipe."""
    return F.substring(F.sha2(F.concat_ws(sep, *parts).cast("binary"), 256), 1, length)


def is_scan(chars: Column, pages: Column) -> Column:
    """At most max(512, 8 a page) characters: a scan (SCA-31). Fixed values."""
    return chars <= F.greatest(F.lit(512), 8 * pages)


def needs_ocr(chars: Column, pages: Column) -> Column:
    """Fewer than max(200, 40 a page) characters (SCA-31). Fixed values."""
    return chars < F.greatest(F.lit(200), 40 * pages)


def stable_json(*cols: str) -> Column:
    """A struct of fields in sorted order as JSON, nulls kept (SCA-21)."""
    return F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"})


# Arrow-batched, where the JVM has no such function


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC; null stays null."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def hmac_sha256(key: str):
    """HMAC-SHA-256 in hex under a fixed key (SCA-20)."""

    @F.pandas_udf(StringType())
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _hmac.new(key.encode(), x.encode(), hashlib.sha256).hexdigest(), na_action="ignore")

    return f


_MARKUP = re.compile(r"<[^>]+>|[#*_`|>-]")


@F.pandas_udf(StringType())
def canonical_ocr(s: pd.Series) -> pd.Series:
    """Markup off, NFKC, letters and digits only, lower case (SCA-15)."""
    def f(x: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKC", _MARKUP.sub(" ", x)).lower() if c.isalnum())

    return s.map(f, na_action="ignore")
