"""Linking of the spellings under which an organisation was typed (problem 1).

Distinct names are read once (:mod:`tidegraph.llm.orgnames`) into keys: kind of
business, number of a unit, letters of the proper part. Only distinct keys are
compared. What tells the kind is learnt from the names (:mod:`tidegraph.llm.kinds`).

*Pigeonhole segment join.* Two strings within ``k`` edits share one of ``k + 1``
segments of the shorter one, moved by at most ``k`` places, unless a
transposition lies across a border and spoils two. So the first and the last
segment are indexed a second time with the letter beyond their border in place
of their own: with the transposition undone that segment is whole, or the one
at the other end is. Each key is put into an inverted index under its
segments; every key looks up the substrings that could be such a segment of a
partner, position shifts included, and itself with two neighbouring syllables
exchanged. The pairs found are verified by a banded edit distance
(transpositions count one). A segment that more than ``HOT`` index strings share
is not paired out: what remains of the strings once the segment is taken off is
itself cut into ``k + 1`` segments, one of which must agree too, and so on until
no segment is shared by so many, so nothing is lost and no pair is capped.

Keys of different kinds or unit numbers are never compared: sister companies
and numbered units are different organisations. A name without its kind, with
an initial or the consonants for its second word, or blended into one word is
attached only where exactly one organisation fits. A record whose names lead to
two keys (a trade name beside the full one) joins them; groups come from
:func:`tidegraph.llm.groups.linked_groups`.

Defined results: null, empty and unreadable names and bare acronyms link
nothing by themselves; a record alone in its group gives no pair; repeated
records are linked to each other; ambiguous short names stay unlinked.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.groups import linked_groups
from tidegraph.llm.kinds import learn
from tidegraph.llm.orgnames import Kinds, Reader
from tidegraph.plans import skew
from tidegraph.plans.scratch import Scope, materialise

HOT = 32
#: Below this length names of different organisations may lie two edits apart.
SHORT = 12
#: Times that the commoner of two short spellings two edits apart must be typed for each time of the other.
TIMES = 4
_SYLLABLE = re.compile(r"[^aeiou]*[aeiou](?:n(?![aeiou]))?")
_VOWELS = re.compile("[aeiou]")


def edits(size: int) -> int:
    """Edits allowed to a string of that many letters."""
    return 2 if size >= 8 else 1 if size >= 5 else 0


def distance(a: str, b: str, k: int) -> int:
    """Edit distance with transpositions, computed in a band of width ``2k + 1``; ``k + 1`` if greater than ``k``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > k:
        return k + 1
    far = k + 1
    before: list[int] = []
    row = [j if j <= k else far for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        low, high = max(1, i - k), min(len(b), i + k)
        new = [far] * (len(b) + 1)
        if i <= k:
            new[0] = i
        for j in range(low, high + 1):
            best = min(row[j - 1] + (a[i - 1] != b[j - 1]), row[j] + 1, new[j - 1] + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, before[j - 2] + 1)
            new[j] = best
        if min(new) > k:
            return far
        before, row = row, new
    return min(row[len(b)], far)


def syllables(s: str) -> list[str]:
    found = _SYLLABLE.findall(s)
    rest = s[sum(map(len, found)) :]
    return [*found, rest] if rest else found


def swapped(a: str, b: str) -> bool:
    """The strings differ by two neighbouring syllables that changed places."""
    if len(a) != len(b) or len(a) < 8:
        return False
    x, y = syllables(a), syllables(b)
    off = [i for i in range(min(len(x), len(y))) if x[i] != y[i]]
    return len(x) == len(y) and len(off) == 2 and off[1] == off[0] + 1 and x[off[0]] == y[off[1]] and x[off[1]] == y[off[0]]


def same_spelling(a: str, b: str) -> bool:
    k = edits(min(len(a), len(b)))
    return distance(a, b, k) <= k or swapped(a, b)


def segments(size: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of ``k + 1`` segments, the longer ones last."""
    short, longer = divmod(size, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        n = short + (i >= k + 1 - longer)
        out.append((at, n))
        at += n
    return out


def turned(s: str, k: int) -> list[tuple[int, str]]:
    """(segment, string): the string with the letters at the first segment's end, or before the last one, exchanged."""
    cut = segments(len(s), k)
    out = []
    for i, at in {0: cut[0][1], k: cut[k][0]}.items() if k else ():
        if 0 < at < len(s) and s[at - 1] != s[at] and cut[i][1]:
            out.append((i, s[: at - 1] + s[at] + s[at - 1] + s[at + 1 :]))
    return out


def index_segments(s: str, k: int) -> Iterator[tuple[str, str]]:
    """(segment, rest): each segment of ``s`` by number and letters, and what remains without it; a string of ``k`` letters or less isn't cut."""
    if len(s) <= k:
        yield "", ""
        return
    cut = segments(len(s), k)
    for i, t in [*((i, s) for i in range(k + 1)), *turned(s, k)]:
        p, n = cut[i]
        yield f"{i}.{t[p : p + n]}", t[:p] + t[p + n :]


def lookup_segments(s: str, size: int, k: int) -> Iterator[tuple[str, str, int]]:
    """(segment, rest, partner's rest): substrings of ``s`` that may be a segment of a partner of that size."""
    if size <= k:
        yield "", "", 0
        return
    delta = len(s) - size
    for i, (p, n) in enumerate(segments(size, k)):
        for q in range(max(0, p - (k - delta) // 2), min(len(s) - n, p + (k + delta) // 2) + 1):
            yield f"{i}.{s[q : q + n]}", s[:q] + s[q + n :], size - n


def exchanged(s: str) -> Iterator[str]:
    """The string with two neighbouring syllables in each other's place."""
    x = syllables(s)
    for i in range(len(x) - 1 if len(s) >= 8 else 0):
        if x[i] != x[i + 1] and syllables(t := "".join([*x[:i], x[i + 1], x[i], *x[i + 2 :]])) == [*x[:i], x[i + 1], x[i], *x[i + 2 :]]:
            yield t


def index_rows(s: str) -> Iterator[tuple[str, str]]:
    """(segment, rest) of a key's string; the whole string stands for itself."""
    k = edits(len(s))
    for seg, rest in index_segments(s, k):
        yield f"{len(s)}.{seg}", rest
    yield f"w.{s}", ""


def lookup_rows(s: str, both: bool) -> Iterator[tuple[str, str, int, int]]:
    """(segment, rest, partner's rest, edits) for partners no longer than ``s``, or of either length."""
    for size in range(max(1, len(s) - 2), len(s) + (2 if both else 0) + 1):
        k = edits(size)
        if abs(len(s) - size) <= k:
            for seg, rest, other in lookup_segments(s, size, k):
                yield f"{size}.{seg}", rest, other, k
    for t in exchanged(s):
        yield f"w.{t}", "", 0, 0


def _rows(columns: list[list], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


_TEXT, _INT = pa.string(), pa.int32()
_INDEX, _LOOK = "seg string, key string, s string, rest string", "seg string, key string, s string, rest string, other int, k int"


def _filled(rows: Iterator[tuple], names: list[str]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows)] or [[] for _ in names]
    return _rows(columns, names, [_TEXT] * 4 + [_INT] * (len(names) - 4))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = zip(*[b.column(c).to_pylist() for c in ("block", "key", "s")])
        yield _filled(((f"{block}.{seg}", key, s, rest) for block, key, s in keys for seg, rest in index_rows(s)), ["seg", "key", "s", "rest"])


def _looking(both: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = zip(*[b.column(c).to_pylist() for c in ("block", "key", "s")])
            yield _filled(((f"{block}.{seg}", key, s, rest, other, k) for block, key, s in keys for seg, rest, other, k in lookup_rows(s, both)), ["seg", "key", "s", "rest", "other", "k"])

    return run


def _indexed_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of hot segments, by the segments of what remains."""
    for b in batches:
        rows = zip(*[b.column(c).to_pylist() for c in ("seg", "key", "s", "rest")])
        yield _filled(((f"{seg}/{part}", key, s, left) for seg, key, s, rest in rows for part, left in index_segments(rest, edits(len(s)))), ["seg", "key", "s", "rest"])


def _looking_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(*[b.column(c).to_pylist() for c in ("seg", "key", "s", "rest", "other", "k")])
        yield _filled(((f"{seg}/{part}", key, s, left, less, k) for seg, key, s, rest, other, k in rows for part, left, less in lookup_segments(rest, other, k)), ["seg", "key", "s", "rest", "other", "k"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [same_spelling(x, y) for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist())]
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def segment_join(left: DataFrame, right: DataFrame, both: bool, hot_size: int = HOT) -> DataFrame:
    """Pairs (a, b) of keys of ``left`` and ``right`` (block, key, s) of one block whose strings agree but for edits.

    With ``both`` false only partners no longer than the left string are looked for, as in a self-join.
    """
    index = materialise(right.mapInArrow(_indexed, _INDEX), "segments")
    looks = left.mapInArrow(_looking(both), _LOOK)
    pair = [F.col("l.key").alias("a"), F.col("r.key").alias("b"), F.col("l.s").alias("sa"), F.col("r.s").alias("sb")]
    found = None
    while True:
        # A segment whose strings have nothing left can't be cut further; they are spellings of one string.
        shared = index.groupBy("seg").agg(F.count("*").alias("n"), F.max(F.length("rest")).alias("left")).where((F.col("n") > hot_size) & (F.col("left") > 0)).select("seg")
        hot = materialise(shared, "hot-segments")
        done = hot.isEmpty()
        x, y = (looks, index) if done else (looks.join(hot, "seg", "left_anti"), index.join(hot, "seg", "left_anti"))
        part = x.select("seg", "key", "s").alias("l").join(y.select("seg", "key", "s").alias("r"), "seg").where("l.key <> r.key").select(*pair)
        found = part if found is None else found.unionByName(part)
        if done:
            return found.distinct().mapInArrow(_verified, "a string, b string").distinct()
        looks = materialise(looks.join(hot, "seg", "left_semi").mapInArrow(_looking_rest, _LOOK), "hot-looks")
        index = materialise(index.join(hot, "seg", "left_semi").mapInArrow(_indexed_rest, _INDEX), "hot-index")


def _blend(words: tuple[str, ...]) -> str:
    """First word without its last syllable, and the first syllable of the second."""
    one, two = syllables(words[0]), syllables(words[1])
    return "".join(one[:-1]) + two[0] if len(one) > 1 else ""


def _signs(words: tuple[str, ...]) -> list[str]:
    """Short forms under which a name of two full words may be typed."""
    return [f"i:{words[0]}.{words[1][0]}", f"c:{words[0]}.{_VOWELS.sub('', words[1])}", f"b:{_blend(words)}"]


def _asks(words: tuple[str, ...], hangul: bool) -> list[str]:
    """Short forms that the typed words may be."""
    if hangul:
        return []
    if len(words) == 2 and len(words[1]) == 1:
        return [f"i:{words[0]}.{words[1]}"]
    if len(words) == 2 and not _VOWELS.search(words[1]):
        return [f"c:{words[0]}.{words[1]}"]
    if len(words) == 1 or len(words) == 2 and len(syllables(words[1])) == 1:
        return [f"b:{''.join(words)}"]
    return []


_READ = "name string, kind string, unit string, core string, words array<string>, signs array<string>, asks array<string>"


def _readings(kinds: Kinds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(kinds)
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for name in b.column("name").to_pylist():
                for r in dict.fromkeys(reader.read(name)):
                    asks = _asks(r.words, r.hangul)
                    full = len(r.words) == 2 and not r.hangul and not (asks and asks[0][0] in "ic")
                    for col, v in zip(out, (name, r.kind, r.unit, r.core, list(r.words), _signs(r.words) if full else [], asks)):
                        col.append(v)
            many = pa.list_(_TEXT)
            yield _rows(out, ["name", "kind", "unit", "core", "words", "signs", "asks"], [_TEXT] * 4 + [many] * 3)

    return run


def plausible(pairs: DataFrame, keys: DataFrame, second: tuple[str, ...] = ()) -> DataFrame:
    """Pairs that are slips of each other rather than two short names.

    Short spellings one edit or one transposition of neighbours apart are slips.
    Two edits apart they are different organisations unless one is typed ``TIMES``
    times as often as the other, a ratio that doesn't depend on how many rows there
    are; trade names (kinds of the second rank), shorter than others, may differ by
    one edit only. ``n`` counts typings, not extractions of them.
    """
    k = lambda x: keys.select(F.col("key").alias(x), F.col("core").alias(f"core_{x}"), F.col("kind").alias(f"kind_{x}"), F.col("n").alias(f"n_{x}"))
    j = pairs.join(k("a"), "a").join(k("b"), "b")
    low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    long = F.least(F.length("core_a"), F.length("core_b")) >= SHORT
    edit = F.levenshtein("core_a", "core_b")
    letters = lambda c: F.array_sort(F.split(c, ""))
    moved = (edit == 2) & (letters(F.col("core_a")) == letters(F.col("core_b")))
    off = F.filter(F.sequence(F.lit(1), F.length("core_a")), lambda i: F.substr(F.col("core_a"), i, F.lit(1)) != F.substr(F.col("core_b"), i, F.lit(1)))
    slip = (edit <= 1) | (moved & (F.size(off) == 2) & (F.array_max(off) - F.array_min(off) == 1))
    trade = F.col("kind_a").isin(*second) if second else F.lit(False)
    return j.where(long | slip | ((high >= TIMES * low) & (~trade | moved))).select("a", "b")


def _strings(keys: DataFrame, block) -> DataFrame:
    """(block, key, s): the letters of a key, in both orders of two words."""
    orders = F.when((F.size("words") == 2) & (F.size("signs") > 0), F.array("core", F.concat(F.col("words")[1], F.col("words")[0]))).otherwise(F.array("core"))
    return keys.select(block.alias("block"), "key", F.explode(F.array_distinct(orders)).alias("s"))


def organisation_groups(records: DataFrame) -> DataFrame:
    """(rec, org, group_id) of the records (rec bigint, org boolean, type string, typed string, names array<string>) that could be read.

    ``typed`` is the same for records of one typing, as a finding that was extracted twice.
    """
    named_by = materialise(records.select("rec", "type", "typed", F.explode(F.array_distinct(F.filter("names", lambda n: n.isNotNull()))).alias("name")), "names")
    counted = materialise(named_by.groupBy("name").agg(F.count("*").alias("n")), "distinct-names")
    both = records.where("type IS NOT NULL OR size(names) > 1").select(F.element_at("names", 1).alias("name"), F.element_at("names", -1).alias("english"), "type")
    kinds = learn(counted, both)
    hints = F.create_map(*[F.lit(x) for pair in kinds.types for x in pair])[F.col("type")] if kinds.types else F.lit(None).cast("string")
    hot = skew.hot_keys(counted, ["name"])
    # Each distinct name is read once, in as many tasks as there are cores.
    read_names = materialise(counted.select("name").repartition(counted.sparkSession.sparkContext.defaultParallelism, "name").mapInArrow(_readings(kinds), _READ).withColumn("key", F.concat_ws("|", "kind", "unit", "core")), "read-names")
    each = skew.spread(named_by.withColumn("hint", hints), hot, ["name"], F.col("rec")).join(skew.repeat(read_names.select("name", "key", "kind"), hot, ["name"]), ["name", "_salt"])
    read_ = materialise(each.select("rec", "hint", "typed", "kind", "key").distinct(), "readings")
    typings = read_.groupBy("key").agg(F.count_distinct("typed").alias("n"))
    keys = read_names.groupBy("key", "kind", "unit", "core").agg(F.max(F.struct(F.size("signs").alias("n"), "words", "signs")).alias("w"), F.max("asks").alias("asks"))
    keys = materialise(keys.join(typings, "key").select("key", "kind", "unit", "core", "w.words", "w.signs", "asks", "n"), "keys")
    initial = F.size(F.filter("asks", lambda a: a.startswith("i:"))) > 0
    told_kinds = F.col("kind") != "" if kinds.phrases or kinds.endings else F.lit(True)  # without kinds all names are whole
    named = keys.where(told_kinds & ~initial)
    block = F.concat_ws("|", "kind", "unit")
    own = named.select(F.col("key").alias("a"), F.col("key").alias("b"))
    with Scope() as scope:
        alike = plausible(segment_join(named.select(block.alias("block"), "key", F.col("core").alias("s")), _strings(named, block), both=False), named, kinds.second)
        spelled = scope.keep(materialise(linked_groups(alike.unionByName(own), "a", "b").select(F.col("record_id").alias("key"), F.col("group_id").alias("family")), "spelled"))

    # Short forms: attached where their full names belong to one family.
    full = named.select("unit", "kind", "key", F.explode("signs").alias("sign"))
    short = keys.select(F.col("key").alias("a"), "unit", F.col("kind").alias("kind_a"), F.explode("asks").alias("sign"))
    forms = materialise(short.join(full, ["unit", "sign"]).where("a <> key AND (kind_a = '' OR kind_a = kind)").select("a", "kind_a", F.col("key").alias("b")).distinct(), "forms")
    told_kind = forms.where("kind_a <> ''").join(spelled.withColumnRenamed("key", "b"), "b").groupBy("a").agg(F.min("family").alias("family"), F.max("family").alias("other")).where("family = other")
    # A short form's own family, if it has one, becomes part of the full names' family.
    merged = told_kind.join(spelled.select(F.col("key").alias("a"), F.col("family").alias("own")), "a", "left").select(F.coalesce("own", "a").alias("own"), "family")
    merged = materialise(merged.groupBy("own").agg(F.min("family").alias("into")), "merged")
    all_keys = spelled.unionByName(told_kind.join(spelled.select(F.col("key").alias("a")), "a", "left_anti").select(F.col("a").alias("key"), "family"))
    families = materialise(all_keys.join(merged, F.col("family") == F.col("own"), "left").select("key", F.coalesce("into", "family").alias("family")), "families")

    # Names without a kind: one family of their letters and unit, or of the kind their record tells.
    bare = keys.where(~told_kinds).select(F.col("unit").alias("block"), "key", F.col("core").alias("s"))
    with Scope() as scope:
        fits = segment_join(bare, _strings(named, F.col("unit")), both=True).unionByName(forms.where("kind_a = ''").select("a", "b"))
        families_of = families.select(F.col("key").alias("b"), "family")
        options = scope.keep(materialise(fits.join(families_of, "b").select("a", "family", F.substring_index("family", "|", 1).alias("kind")).distinct(), "options"))
    count = options.groupBy("a").agg(F.count("*").alias("n"), F.min("family").alias("only"))
    one = materialise(count.where("n = 1").select(F.col("a").alias("key"), F.col("only").alias("family")), "attached")
    per_kind = options.join(count.where("n > 1").select("a"), "a").groupBy("a", "kind").agg(F.count("*").alias("n"), F.min("family").alias("family")).where("n = 1")
    told = read_.where("kind = ''").join(per_kind.select(F.col("a").alias("key"), F.col("kind").alias("hint"), "family"), ["key", "hint"]).select("rec", "family")

    links = read_.select("rec", "key").join(families.unionByName(one), "key").select("rec", "family").unionByName(told).distinct()
    named_f = lambda c: F.concat(F.lit("f:"), F.col(c))
    edges = links.select(F.concat(F.lit("r:"), F.col("rec").cast("string")).alias("a"), named_f("family").alias("b"))
    edges = edges.unionByName(merged.select(named_f("own").alias("a"), named_f("into").alias("b")))
    joined = linked_groups(edges, "a", "b")
    who = joined.where("record_id LIKE 'r:%'").select(F.substring("record_id", 3, 40).cast("bigint").alias("rec"), "group_id")
    return records.select("rec", "org").distinct().join(who, "rec")


def organisation_pairs(records: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """(id_a, id_b): an organisation and a later organisation or a finding that names it."""
    with Scope() as scope:
        members = scope.keep(materialise(organisation_groups(records), "members"))
    hot = skew.hot_keys(members.groupBy("group_id").agg(F.count("*").alias("n")), ["group_id"], "n", hot_rows)
    orgs = members.where("org").select("group_id", F.col("rec").alias("id_a"))
    all_ = members.select("group_id", F.col("rec").alias("id_b"))
    left = skew.spread(all_, hot, ["group_id"], F.col("id_b"))
    return left.join(skew.repeat(orgs, hot, ["group_id"]), ["group_id", "_salt"]).where("id_a < id_b").select("id_a", "id_b").distinct()


def records(orgs: DataFrame, findings: DataFrame) -> DataFrame:
    """Records of organizations and of extracted_relations that name one."""
    own = lambda c: F.concat(F.lit("r:"), F.col(c).cast("string"))
    typed = own("relation_id")
    if "source_id" in findings.columns:
        typed = F.when(F.col("source_id").isNotNull(), F.to_json(F.struct("source_id", "target_name"))).otherwise(typed)
    a = orgs.select(F.col("org_id").alias("rec"), F.lit(True).alias("org"), F.col("org_type").alias("type"), own("org_id").alias("typed"), F.array("name", "name_en").alias("names"))
    b = findings.where("target_type = 'Organization' AND target_name IS NOT NULL").select(F.col("relation_id").alias("rec"), F.lit(False).alias("org"), F.lit(None).cast("string").alias("type"), typed.alias("typed"), F.array("target_name").alias("names"))
    return a.unionByName(b).where("rec IS NOT NULL")
