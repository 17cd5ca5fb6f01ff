"""Keyword-stuffed and link-list pages (problem 9).

1. Every page is cut into words once, numbers left out.
2. SQL windows rank each page's frequencies (words of one frequency share their
   middle rank) and a least-squares line is fitted to log frequency over log
   rank: its slope and residual.
3. The third figure is the divergence (Jensen-Shannon) of the page's word
   frequencies from those of the prose of its language: the mean share of each
   word over the language's pages whose curve isn't extreme.
4. Each figure is held against same-language pages of comparable length (bands
   of a factor of two, where pairs of characters count half): how many spreads it lies beyond their median. Spam may
   fill a band of long pages, and the divergence of prose falls with length, so
   a band's median divergence is at most that of every shorter band; spreads are
   taken over the whole language.

A page is a case if its own slope, residual or divergence is extreme; nothing is
learnt from the cases. A word's share is kept from ``LEAST_SHARE`` on, which
leaves at most ``1 / LEAST_SHARE`` words per language whatever the corpus holds;
rarer words count as absent from prose, for every page alike.

Defined results: null, empty and blank texts and pages without a word are no
cases; a page in a language without a label is compared with the language it
diverges least from; a page without comparable pages, as the only one of its
language, is no case; repeated rows are judged alike.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.plans.scratch import drop_scratch, materialise

#: Spreads beyond the middle from which a figure is extreme.
EXTREME = {"slope": 8.0, "residual": 8.0, "divergence": 3.85}
#: Smallest spread that a language is taken to have.
FLOOR = {"slope": 0.08, "residual": 0.05, "divergence": 0.03}
#: Words from which a page's figures are steady.
STEADY = 100
LEAST_SHARE = 1e-5

_HIDDEN = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W\d_]+")
_UNSPACED = re.compile("[぀-ヿ一-鿿]")
_HANGUL = re.compile("[가-힣]")
_KANA = re.compile("[぀-ヿ]")
_LANGUAGES = {"eng": "en", "kor": "ko", "jpn": "ja", "spa": "es", "por": "pt", "nor": "no", "nob": "no", "nb": "no", "nn": "no", "fra": "fr", "fre": "fr"}


def language(label: str | None, text: str) -> str:
    """Two-letter code of a label in whatever spelling, else a guess by script, else ``?``."""
    code = re.split("[-_ ]", (label or "").strip().lower())[0]
    code = _LANGUAGES.get(code, code)
    if len(code) == 2 and code.isascii() and code.isalpha():
        return code
    letters = sum(c.isalpha() for c in text) or 1
    if len(_HANGUL.findall(text)) > 0.3 * letters:
        return "ko"
    return "ja" if len(_KANA.findall(text)) > 0.2 * letters else "?"


def words(text: str) -> list[str]:
    """Lower-case runs of letters; unspaced scripts go by pairs of characters."""
    if text.isascii():
        return _WORD.findall(text.lower())
    found = _WORD.findall(_HIDDEN.sub("", unicodedata.normalize("NFKC", text)).lower())
    if not _UNSPACED.search(text):
        return found
    out: list[str] = []
    for w in found:
        if _UNSPACED.search(w):
            out += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
        else:
            out.append(w)
    return out


_PAGES = "lang string, n bigint, size bigint, words array<string>, counts array<int>, freq array<int>, number array<int>"


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep: list[int] = []
        out: list[list] = [[] for _ in range(7)]
        for i, (label, text) in enumerate(zip(b.column("lang").to_pylist(), b.column("text").to_pylist())):
            found = Counter(words(text))
            if not found:
                continue
            spectrum = Counter(found.values())
            keep.append(i)
            n = sum(found.values())
            pairs = 0 if text.isascii() else sum(k for w, k in found.items() if len(w) == 2 and _UNSPACED.search(w))
            row = (language(label, text), n, n - pairs // 2, list(found), list(found.values()), list(spectrum), list(spectrum.values()))
            for col, v in zip(out, row):
                col.append(v)
        ints = pa.list_(pa.int32())
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), ints, ints, ints]
        yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(keep, pa.int64())), *[pa.array(c, k) for c, k in zip(out, kinds)]], names=["key", "lang", "n", "size", "words", "counts", "freq", "number"])


def _curves(pages: DataFrame) -> DataFrame:
    """(row, slope, residual) of the line through log frequency over log middle rank."""
    rows = pages.select("row", F.explode(F.arrays_zip("freq", "number")).alias("s")).select("row", F.col("s.freq").alias("f"), F.col("s.number").alias("v"))
    above = F.coalesce(F.sum("v").over(Window.partitionBy("row").orderBy(F.col("f").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = rows.select("row", "f", "v", F.log(above + (F.col("v") + 1) / 2).alias("x"), F.log("f").alias("y"))
    v, x, y = F.col("v"), F.col("x"), F.col("y")
    sums = at.groupBy("row").agg(F.sum(v * F.col("f")).alias("n"), F.sum(v).alias("w"), F.sum(v * x).alias("sx"), F.sum(v * y).alias("sy"), F.sum(v * x * x).alias("sxx"), F.sum(v * x * y).alias("sxy"), F.sum(v * y * y).alias("syy"))
    w = F.col("w")
    vx, vy, xy = F.col("sxx") / w - (F.col("sx") / w) ** 2, F.col("syy") / w - (F.col("sy") / w) ** 2, F.col("sxy") / w - F.col("sx") * F.col("sy") / w / w
    flat = vx < 1e-9
    # One frequency for all words has no slope over ranks: single words are level, repeated ones as steep as they are many.
    return sums.select("row", F.when(flat, -F.log(F.col("n") / w)).otherwise(xy / vx).alias("slope"), F.sqrt(F.greatest(F.lit(0.0), F.when(flat, vy).otherwise(vy - xy * xy / vx))).alias("residual"))


def _middle(c: Column) -> Column:
    return F.percentile_approx(c, 0.5, 1000)


def _held(figures: DataFrame, known: DataFrame, name: str, sign: int, falling: bool = False) -> DataFrame:
    """``figures`` with ``z_<name>``: spreads by which the figure lies beyond the middle of ``known`` pages of its language and band.

    The tables of middles have a row per language and band, a few thousand at most, so they may be broadcast.
    """
    value = sign * F.col(name)
    middle = known.groupBy("lang", "band").agg(_middle(value).alias("_m"))
    if falling:
        middle = middle.withColumn("_m", F.min("_m").over(Window.partitionBy("lang").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)))
    near = F.broadcast(middle)
    spread = known.join(near, ["lang", "band"]).groupBy("lang").agg((1.4826 * _middle(F.abs(value - F.col("_m")))).alias("_s"))
    floor = F.lit(FLOOR[name]) * F.greatest(F.lit(1.0), F.sqrt(F.lit(STEADY) / F.col("size")))  # figures of few words scatter
    out = figures.join(near, ["lang", "band"], "left").join(F.broadcast(spread), "lang", "left")
    return out.withColumn(f"z_{name}", (value - F.col("_m")) / F.greatest("_s", floor)).drop("_m", "_s")


def _shares(pages: DataFrame) -> DataFrame:
    return pages.select("row", "lang", "n", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("row", "lang", F.col("w.words").alias("word"), (F.col("w.counts") / F.col("n")).alias("p"))


def _prose(pages: DataFrame) -> DataFrame:
    """(lang, word, q): mean share of a word in the pages of a language, from ``LEAST_SHARE`` on."""
    size = pages.groupBy("lang").agg(F.count("*").alias("pages"))
    total = _shares(pages).groupBy("lang", "word").agg(F.sum("p").alias("p"))
    return total.join(F.broadcast(size), "lang").select("lang", "word", (F.col("p") / F.col("pages")).alias("q")).where(F.col("q") >= LEAST_SHARE)


def _divergence(pages: DataFrame, prose: DataFrame, langs: list[str]) -> DataFrame:
    """(row, lang, divergence): from the prose of the page's language, or of the nearest one if it has none."""
    every = F.array(*map(F.lit, langs))
    tried = pages.withColumn("lang", F.explode(F.when(F.col("lang") == "?", every).otherwise(F.array("lang"))))
    p, q = F.col("p"), F.coalesce("q", F.lit(0.0))
    middle = (p + q) / 2
    term = p / 2 * F.log(p / middle) + F.when(q > 0, q / 2 * F.log(q / middle)).otherwise(0.0)
    # The table of shares has a known size, so the planner broadcasts it by its own threshold or shuffles.
    per = _shares(tried).join(prose, ["lang", "word"], "left").groupBy("row", "lang").agg((F.sum(term) + (1 - F.sum(q)) * (F.log(F.lit(2.0)) / 2)).alias("divergence"))
    return per.groupBy("row").agg(F.min(F.struct("divergence", "lang")).alias("m")).select("row", "m.lang", "m.divergence")


def page_figures(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(key, lang, n, slope, residual, divergence, z_slope, z_residual, z_divergence, found) of every page that has words."""
    src = docs.select(docs[key].alias("key"), docs[lang].cast("string").alias("lang"), docs[text].alias("text")).where("text IS NOT NULL")
    kind = src.schema["key"].dataType.simpleString()
    cut = materialise(src.mapInArrow(_pages, f"key {kind}, {_PAGES}").withColumn("row", F.monotonically_increasing_id()), "pages")
    curves = _curves(cut).join(cut.select("row", "key", "lang", "n", "size"), "row").withColumn("band", F.floor(F.log2("size")))
    curves = materialise(curves, "curves")
    langs = sorted(r["lang"] for r in curves.select("lang").distinct().collect())  # two-letter codes
    labelled = F.col("lang") != "?" if langs != ["?"] else F.lit(True)
    known = curves.where(labelled)
    ranked = _held(_held(known, known, "slope", -1), known, "residual", 1)
    steep = ranked.where((F.col("z_slope") > EXTREME["slope"]) | (F.col("z_residual") > EXTREME["residual"])).select("row")
    prose = materialise(_prose(cut.where(labelled).join(steep, "row", "left_anti")), "prose")
    figures = materialise(curves.drop("lang").join(_divergence(cut, prose, [x for x in langs if x != "?"] or langs), "row"), "figures")
    drop_scratch(cut, curves, prose)
    out = _held(_held(_held(figures, figures, "slope", -1), figures, "residual", 1), figures, "divergence", 1, falling=True)
    extreme = [F.coalesce(F.col(f"z_{c}") > limit, F.lit(False)) for c, limit in EXTREME.items()]
    return out.select(F.col("key").alias(key), "lang", "n", *EXTREME, *[f"z_{c}" for c in EXTREME], (extreme[0] | extreme[1] | extreme[2]).alias("found"))


def spam_pages(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    return page_figures(docs, key, text, lang).where("found")
