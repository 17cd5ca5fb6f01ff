"""Column functions on text: words, clean-up, personal data, similarity of strings."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

#: White space of Unicode that occurs in text, written out so that every engine agrees on it.
SPACES = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def words(c: Column | str) -> Column:
    """Lower-case words between white space; null for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(c), f"{SPACES}+"), lambda w: w != "")


def normal_space(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, f"{SPACES}+", " "), "^ | $", "")


# Corporate suffixes, as patterns.
SUFFIXES = ("co\\.?\\s*,?\\s*ltd\\.?", "ltd\\.?", "inc\\.?", "corp\\.?", "corporation", "company", "주식회사", "㈜", "\\(주\\)")


def entity_name(c: Column) -> Column:
    """Lower case, without one trailing corporate suffix, single blanks."""
    bare = F.regexp_replace(F.lower(F.trim(c)), f"\\s*(?:{'|'.join(SUFFIXES)})\\s*$", "")
    return F.trim(F.regexp_replace(bare, "\\s+", " "))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """``1 - distance / longer length``; 1 for equal strings, 0 if one is empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def ngrams(c: Column, n: int = 3) -> Column:
    size = F.length(c) - n + 1
    return F.when(size >= 1, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def ngram_cosine(a: Column, b: Column, n: int = 3) -> Column:
    """Cosine of n-gram counts; strings shorter than ``n`` agree only if equal."""
    ga, gb = ngrams(a, n), ngrams(b, n)
    count = lambda grams, g: F.size(F.filter(grams, lambda x: x == g)).cast("double")
    norm = lambda grams: F.sqrt(F.aggregate(F.array_distinct(grams), F.lit(0.0), lambda acc, g: acc + count(grams, g) * count(grams, g)))
    dot = F.aggregate(F.array_intersect(ga, gb), F.lit(0.0), lambda acc, g: acc + count(ga, g) * count(gb, g))
    return F.when(a == b, F.lit(1.0)).when((F.length(a) < n) | (F.length(b) < n), F.lit(0.0)).otherwise(dot / (norm(ga) * norm(gb)))


def hybrid_similarity(a: Column, b: Column, weight: float = 0.6) -> Column:
    """Levenshtein and trigram similarity, weighted."""
    if not 0 <= weight <= 1:
        raise ValueError("the weights must sum to 1")
    return weight * levenshtein_similarity(a, b) + (1 - weight) * ngram_cosine(a, b)


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    same_a = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                same_a.append(x)
                break
    if not same_a:
        return 0.0
    same_b = [y for y, t in zip(b, taken) if t]
    m, half = len(same_a), sum(x != y for x, y in zip(same_a, same_b)) / 2
    return (m / len(a) + m / len(b) + (m - half) / m) / 3


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    j, prefix = jaro(a, b), 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return j + prefix * scale * (1 - j)


@pandas_udf(DoubleType())
def jaro_winkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


@pandas_udf(DoubleType())
def fuzzy_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The greater of difflib's ratio and Jaro-Winkler."""
    return pd.Series([None if x is None or y is None else max(SequenceMatcher(None, x, y).ratio(), jaro_winkler(x, y)) for x, y in zip(a, b)], dtype="float64")


# Patterns of personal data.
PERSONAL = {
    "resident_number": r"\b\d{6}-[1-4]\d{6}\b",
    "phone_number": r"\b01[016789]-\d{3,4}-\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "bank_account": r"\b\d{3,6}-\d{2,6}-\d{5,7}\b",
    "passport": r"\b[A-Z]{1,2}\d{7,8}\b",
}


def _bounded(rx: str) -> str:
    """The pattern with its word borders spelled out, since engines differ on whether Hangul belongs to words."""
    inner = rx.removeprefix("\\b").removesuffix("\\b")
    return f"(?<![\\p{{L}}\\p{{N}}_])(?:{inner})(?![\\p{{L}}\\p{{N}}_])"


def personal_counts(c: Column) -> list[Column]:
    """One count per kind of personal data; letters of any script and digits end no word."""
    return [F.coalesce(F.regexp_count(c, F.lit(_bounded(rx))), F.lit(0)).alias(kind) for kind, rx in PERSONAL.items()]


def redact(c: Column, placeholder: str = "[REDACTED]") -> Column:
    """The text with personal data replaced; one pass, so overlapping finds can't cut each other."""
    return F.regexp_replace(c, "|".join(map(_bounded, PERSONAL.values())), placeholder.replace("$", "\\$"))


# Types are given as objects: a worker that imports this module has no session to parse a string.
_SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("value", StringType()), StructField("start", IntegerType()), StructField("stop", IntegerType())]))


@pandas_udf(_SPANS)
def personal_spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All finds with their places, by start."""
    import re

    inner = {k: p.removeprefix(r"\b").removesuffix(r"\b").replace(r"\d", "[0-9]") for k, p in PERSONAL.items()}
    rx = {k: re.compile(rf"(?<!\w)(?:{p})(?!\w)") for k, p in inner.items()}
    for s in texts:
        yield s.map(lambda t: sorted(({"kind": k, "value": m[0], "start": m.start(), "stop": m.end()} for k, r in rx.items() for m in r.finditer(t or "")), key=lambda x: (x["start"], x["kind"])))


def meaningful_share(c: Column) -> Column:
    """Share of letters, digits and plain marks; 0 for an empty text. Below 0.3 a scan needs character recognition."""
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit(r"[\p{L}\p{Nd} .,!?;:()\n\t-]")) / F.length(c)).otherwise(F.lit(0.0))


def hash_embedding(c: Column, size: int = 64) -> Column:
    """A vector made of the text's SHA-256, of length 1: a stand-in where no model is available."""
    digest = F.sha2(c, 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.conv(F.substr(digest, (2 * i) % 64 + 1, F.lit(2)), 16, 10).cast("double") / 255 - 0.5)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(raw, lambda x: x / norm)).otherwise(raw)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length, empty ones and zero vectors."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0), dot / n).otherwise(F.lit(0.0))


def similarity_score(raw: Column, distance: str) -> Column:
    """Raw scores of a vector index mapped to 0..1."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    if distance == "cosine":
        return clamp((raw + 1) / 2)
    if distance == "euclid":
        return 1 / (1 + F.abs(raw))
    if distance == "dot":
        return clamp(raw)
    raise ValueError(f"unknown distance {distance!r}")


def merged(text: str, separator: str, size: int) -> list[str]:
    out: list[list[str]] = []
    held = 0
    for part in text.split(separator):
        if not part.strip(" "):
            continue
        if out and held + len(separator) + len(part) <= size:
            out[-1].append(part)
            held += len(separator) + len(part)
        else:
            out.append([part])
            held = len(part)
    return [separator.join(x) for x in out]


def overlapped(chunks: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    for chunk in chunks:
        tail = out[-1][max(0, len(out[-1]) - overlap) :] if out else ""
        out.append(tail + chunk if len(tail) + len(chunk) <= size else chunk)
    return out


def chunk_merge(c: Column, separator: str = "\n\n", size: int = 512) -> Column:
    """Parts between separators, joined greedily up to ``size`` characters; a longer part is never cut. Linear in the text."""
    if size <= 0:
        raise ValueError("the size must be positive")
    run = pandas_udf(lambda s: s.map(lambda t: None if t is None else merged(t, separator, size)), ArrayType(StringType()))
    return run(c)


def chunk_overlap(chunks: Column, size: int = 512, overlap: int = 50) -> Column:
    """Each chunk behind the last ``overlap`` characters of the chunk before it, where both fit into ``size``."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    run = pandas_udf(lambda s: s.map(lambda x: None if x is None else overlapped(list(x), size, overlap)), ArrayType(StringType()))
    return run(chunks)


def point_id(c: Column, namespace: str = "6ba7b810-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """The name-based id (version 5) of a text in a namespace, by default that of domain names; null for null."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(c, "UTF-8")))
    at = lambda i, n: F.substr(digest, F.lit(i), F.lit(n))
    variant = F.substr(F.lit("89ab"), F.conv(at(17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(at(1, 8), F.lit("-"), at(9, 4), F.lit("-5"), at(14, 3), F.lit("-"), variant, at(18, 3), F.lit("-"), at(21, 12))
