"""Kinds of business, learnt from the names of a corpus (problem 1).

A word that follows very many different first words is no part of a proper name
but says what the organisation does. So is an ending of Hangul names that very
many different letters stand before. Everything is counted over distinct names,
and a word must make up a share of them, so a table of kinds has at most a few
hundred rows whatever the corpus holds, and is the same at every size.

* *Phrases* are the sets of such words that names end with ("port authority").
* A word of names without a phrase *stands for* a phrase's word if the same
  first words occur with that phrase elsewhere ("towing" where others typed
  "towage").
* Words of the second rank ("lines", "group") are rarer, end a name, and aren't
  used beside a phrase.
* Hangul endings and types of organisations get the phrase that the same
  records carry most often.

Defined results: null, blank and unreadable names teach nothing; a corpus
without kinds has none, and its names are compared by their letters alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.orgnames import FILLERS, HANGUL, Kinds, Reader, code_of, latin_words, near, number_of, sides
from tidegraph.plans.scratch import drop_scratch, materialise

#: Share of the distinct first words that a kind's word follows; the same for words of the second rank.
FIRST, SECOND = 0.03, 0.005
#: Share of the distinct Hangul names that end so, and the largest share that one letter before it may have.
ENDING, ONE_LETTER = 0.02, 0.5
#: Fewest different first words, or Hangul names, behind anything that is learnt.
FEWEST = 3
#: Share of votes that settles what a word stands for, or which kind a type of organisation has.
AGREED = 0.7
LONGEST_ENDING = 8


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        heads, rests, hangul = [], [], []
        for name in b.column("name").to_pylist():
            for side in sides(name):
                text, _ = number_of(side)
                if HANGUL.search(text):
                    heads.append(None)
                    rests.append(None)
                    hangul.append("".join(HANGUL.findall(text)))
                elif len(words := [w for w in latin_words(text) if w not in FILLERS]) > 1:
                    heads.append(words[0])
                    rests.append(words[1:])
                    hangul.append(None)
        yield pa.RecordBatch.from_arrays([pa.array(heads, pa.string()), pa.array(rests, pa.list_(pa.string())), pa.array(hangul, pa.string())], names=["head", "rest", "hangul"])


def _phrases(latin: DataFrame, heads: int) -> tuple[list[str], list[tuple[str, ...]]]:
    """Words of the first rank, and the phrases they make."""
    often = latin.select("head", F.explode(F.array_distinct("rest")).alias("w")).groupBy("w").agg(F.count_distinct("head").alias("n"))
    first = [r["w"] for r in often.where(F.col("n") >= max(FEWEST, FIRST * heads)).orderBy(F.col("n").desc(), "w").collect()]
    if not first:
        return [], []
    said = latin.select("head", F.filter("rest", lambda w: w.isin(first)).alias("p")).where("size(p) > 0")
    counted = said.groupBy("p").agg(F.count_distinct("head").alias("n")).where(F.col("n") >= max(FEWEST, FIRST * heads)).collect()
    phrases = [tuple(r["p"]) for r in sorted(counted, key=lambda r: (-r["n"], r["p"]))]
    return first, [p for p in phrases if not any(set(p) < set(q) for q in phrases)]


def _others(latin: DataFrame, first: list[str], phrases: list[tuple[str, ...]], heads: int) -> tuple[list[tuple[str, str]], list[tuple[str, ...]]]:
    """Words that stand for words of phrases, and words of the second rank."""
    marked = latin.select("head", "rest", F.filter("rest", lambda w: w.isin(first)).alias("p"))
    full = [F.array(*map(F.lit, p)) for p in phrases]
    whole = F.lit(False)
    for f in full:
        whole = whole | (F.col("p") == f)
    known = marked.where(whole).groupBy("head").agg(F.min("p").alias("p"), F.max("p").alias("q")).where("p = q").select("head", F.array_join("p", "_").alias("phrase"))
    bare = marked.where("size(p) = 0").select("head", F.explode(F.array_distinct("rest")).alias("w")).distinct()
    votes = bare.join(known, "head").groupBy("w", "phrase").agg(F.count("*").alias("n"))
    by = Window.partitionBy("w")
    # A word that stands beside whole phrases is part of a proper name.
    beside = marked.select(F.explode(F.array_distinct("rest")).alias("w"), whole.cast("int").alias("whole")).groupBy("w").agg(F.avg("whole").alias("b")).where("b <= 0.2").select("w")
    won = votes.join(beside, "w", "left_semi").withColumns({"all": F.sum("n").over(by), "top": F.max("n").over(by)}).where((F.col("n") == F.col("top")) & (F.col("n") >= AGREED * F.col("all")) & (F.col("all") >= max(FEWEST, SECOND / 10 * heads)))
    spoken = {code_of(p): p for p in phrases}
    words = []
    for r in sorted(won.select("w", "phrase").collect()):
        p = spoken[r["phrase"]]
        alike = [x for x in p if near(r["w"], x) or x[:3] == r["w"][:3]]
        if alike or len(p) == 1:
            words.append((r["w"], alike[0] if alike else p[0]))
    taken = {w for w, _ in words} | set(first)
    last = latin.select("head", F.element_at("rest", -1).alias("w"), (F.size(F.filter("rest", lambda w: w.isin(first))) > 0).alias("beside"))
    rare = last.groupBy("w").agg(F.count_distinct("head").alias("n"), F.avg(F.col("beside").cast("int")).alias("b")).where((F.col("n") >= max(FEWEST, SECOND * heads)) & (F.col("b") <= 0.2)).orderBy(F.col("n").desc(), "w")
    second = [r["w"] for r in rare.collect() if r["w"] not in taken and len(r["w"]) > 2]
    parts = [x for p in phrases for x in p]
    return words, [(w,) for w in second if not any(near(w, x) for x in parts)]


def _endings(hangul: DataFrame) -> list[str]:
    """Endings that many different letters stand before."""
    whole = hangul.count()
    size = F.length("hangul")
    cut = hangul.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST_ENDING), size - 1)), lambda k: F.struct(F.right("hangul", k).alias("ending"), F.substr("hangul", size - k, F.lit(1)).alias("before")))).alias("x")).select("x.*")
    per = cut.groupBy("ending", "before").agg(F.count("*").alias("n")).groupBy("ending").agg(F.sum("n").alias("n"), F.max("n").alias("top"))
    found = per.where((F.col("n") >= max(FEWEST, ENDING * whole)) & (F.col("top") <= ONE_LETTER * F.col("n"))).collect()
    # An ending that two longer ones make up is no word of its own.
    long = {r["ending"]: r["n"] for r in found}
    return sorted(e for e in long if sum(n for x, n in long.items() if x != e and x.endswith(e)) < 0.9 * long[e])


def _carried(batches: Iterator[pa.RecordBatch], kinds: Kinds) -> Iterator[pa.RecordBatch]:
    """(what, phrase) of records with a Hangul name or a type, and a Latin name with a phrase."""
    reader = Reader(kinds)
    for b in batches:
        what, phrase = [], []
        for name, english, kind in zip(*[b.column(c).to_pylist() for c in ("name", "english", "type")]):
            said = {r.kind for r in reader.read(english) if r.kind and not r.hangul}
            for code in said if len(said) == 1 else ():
                for r in reader.read(name):
                    if r.hangul and r.kind:
                        what.append(f"e:{r.kind}")
                        phrase.append(code)
                if kind:
                    what.append(f"t:{kind}")
                    phrase.append(code)
        yield pa.RecordBatch.from_arrays([pa.array(what, pa.string()), pa.array(phrase, pa.string())], names=["what", "phrase"])


def learn(names: DataFrame, pairs: DataFrame) -> Kinds:
    """Kinds of a corpus from its names (name) and from records (name, english, type) with two names or a type."""
    tokens = materialise(names.select("name").distinct().mapInArrow(_tokens, "head string, rest array<string>, hangul string").distinct(), "name-words")
    latin, hangul = tokens.where("head IS NOT NULL"), tokens.where("length(hangul) > 1").select("hangul")
    heads = latin.select("head").distinct().count()
    first, phrases = _phrases(latin, heads)
    words, second = _others(latin, first, phrases, heads) if phrases else ([], [])
    endings = _endings(hangul)
    drop_scratch(tokens)
    kinds = Kinds((*phrases, *second), tuple((e, e) for e in endings), tuple(words), second=tuple(map(code_of, second)))
    # How often they go together; a row per ending or type and phrase.
    carried = pairs.mapInArrow(lambda batches: _carried(batches, kinds), "what string, phrase string").groupBy("what", "phrase").agg(F.count("*").alias("n"))
    best: dict[str, tuple[int, int, str]] = {}
    for what, phrase, n in sorted(carried.collect()):
        top, whole, code = best.get(what, (0, 0, ""))
        best[what] = (max(top, n), whole + n, phrase if n > top else code)
    agreed = {w: code for w, (top, whole, code) in best.items() if top >= AGREED * whole}
    return kinds._replace(endings=tuple((e, agreed.get(f"e:{e}", e)) for e in endings), types=tuple((w[2:], c) for w, c in agreed.items() if w.startswith("t:")))
