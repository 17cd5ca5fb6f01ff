"""Splitting oversized items at natural boundaries (problem 4).

1. A worker reads one range of an item with a halo of the text around it, finds
   the paragraph, line, sentence and word ends, and names the range's seam: the
   strongest end near its right border. It reports one row, the length of the
   range and the place of the seam; rows of all ranges are the boundary table.
2. Prefix sums of the lengths turn local places into those of the whole item,
   and each range's seam is stitched to the next one's beginning.
3. Workers are given (start, stop) offsets and read just that text, with the few
   characters before it that the first piece shares with the one before. Pieces
   are cut greedily between two seams and numbered by prefix sums of counts.

A text longer than one range goes this way, whether it lies in a table or in a
file of any size, which is never loaded as a whole; a shorter one is one range
and needs no stitching. Prefix sums go in two levels, so no task holds all
ranges of one item.

Defined results: null gives no piece, an empty text one empty piece; a text
within the limit is one piece; every piece is at most ``limit`` characters
(Unicode code points), starts at most ``overlap`` characters before its
predecessor's end and never after it; where no natural end is in reach the cut
is made at the limit. Repeated rows are split alike. Bytes of a file that are no
UTF-8 become one U+FFFD each.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.plans.scratch import materialise

LIMIT = 512
OVERLAP = 50
RANGE = 1024  #: characters of a text in a table
RANGE_BYTES = 1 << 22  #: bytes of a file
BLOCK = 4096  #: ranges that one task sums up

#: Ends from the strongest to the weakest; the match's end is the cut.
ENDS = (
    re.compile(r"\n[ \t\r]*\n\s*"),
    re.compile(r"\n\s*"),
    re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+[」』”’）]*\s*"),
    re.compile(r"\s+|[、，]"),
)


def ends_of(text: str) -> list[list[int]]:
    """Offsets of the ends of each strength, ascending."""
    return [[m.end() for m in rx.finditer(text)] for rx in ENDS]


def last_end(ends: list[list[int]], low: int, high: int) -> int | None:
    """The last end of the strongest kind in (low, high]."""
    for found in ends:
        i = bisect_right(found, high)
        if i and found[i - 1] > low:
            return found[i - 1]
    return None


def opening(ends: list[list[int]], end: int, overlap: int, least: int) -> int:
    """Where the piece after ``end`` starts: at a word in the overlap, else at its beginning, not before ``least``."""
    words = ends[3]
    i = bisect_right(words, end - overlap - 1)
    return max(words[i] if i < len(words) and words[i] < end else end - overlap, least)


def cut(ends: list[list[int]], first: int, stop: int, limit: int, overlap: int, before: int = 0) -> Iterator[tuple[int, int]]:
    """Pieces (start, end) that cover [first, stop); the first one shares what it can of the ``before`` characters in front of it."""
    done = first
    start = opening(ends, first, overlap, first - before) if before else first
    while stop - start > limit:
        high = start + limit
        end = last_end(ends, max(done, start + limit // 2), high) or last_end(ends, done, high) or high
        yield start, end
        done, start = end, opening(ends, end, overlap, start + 1)
    yield start, stop


def seam(ends: list[list[int]], border: int, limit: int) -> int:
    """Where the range that ends at ``border`` hands over to the next."""
    return last_end(ends, border - limit // 2, border) or border


def stitch(bounds: DataFrame, sums: list[str]) -> DataFrame:
    """Boundary table (item, range_no, last, <sums>, seam_<sums>) with ``start_<x>`` and ``stop_<x>`` of every range.

    ``<x>`` is the length of a range in some unit, ``seam_<x>`` the place of its seam from the range's beginning;
    the last range of an item has its end for a seam.
    """
    block = materialise(bounds, "ranges").withColumn("block", F.floor(F.col("range_no") / BLOCK))
    upto = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    per = block.groupBy("item", "block").agg(*[F.sum(x).alias(x) for x in sums])
    per = per.select("item", "block", *[F.coalesce(F.sum(x).over(upto(["item"], "block")), F.lit(0)).alias(f"_{x}") for x in sums])
    inner = block.select("*", *[F.coalesce(F.sum(x).over(upto(["item", "block"], "range_no")), F.lit(0)).alias(f"base_{x}") for x in sums]).join(per, ["item", "block"])
    at = materialise(inner.select("item", "range_no", *[(F.col(f"base_{x}") + F.col(f"_{x}") + F.col(f"seam_{x}")).alias(f"stop_{x}") for x in sums]), "boundaries")
    left = at.select("item", (F.col("range_no") + 1).alias("range_no"), *[F.col(f"stop_{x}").alias(f"start_{x}") for x in sums])
    return at.join(left, ["item", "range_no"], "left").withColumns({f"start_{x}": F.coalesce(f"start_{x}", F.lit(0).cast("bigint")) for x in sums})


# Texts in a table ------------------------------------------------------------------------------------


def _batch(columns: list[list], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _bounds(size: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
                for no, at in enumerate(range(0, len(text), size)):
                    low, high = max(0, at - limit), min(len(text), at + size)
                    last = high == len(text)
                    place = high if last else low + seam(ends_of(text[low : high + limit]), high - low, limit)
                    for col, v in zip(out, (item, no, high - at, place - at)):
                        col.append(v)
            yield _batch(out, ["item", "range_no", "chars", "seam_chars"], [pa.string(), pa.int64(), pa.int64(), pa.int64()])

    return run


def _emit(limit: int, overlap: int):
    """Pieces of texts between the (start, stop) of their ranges; a text without ranges is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], [[], [], [], []]
            for row, (text, ranges) in enumerate(zip(b.column("text").to_pylist(), b.column("ranges").to_pylist())):
                no = 0
                for r in ranges or [{"start": 0, "stop": len(text)}]:
                    before = min(overlap, r["start"])
                    base = r["start"] - before
                    part = text[base : r["stop"]]
                    for s, e in cut(ends_of(part), before, len(part), limit, overlap, before):
                        rows.append(row)
                        for col, v in zip(out, (no, base + s, base + e, part[s:e])):
                            col.append(v)
                        no += 1
            key = b.column("key").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([key, *[pa.array(c, k) for c, k in zip(out, [pa.int64(), pa.int64(), pa.int64(), pa.string()])]], names=["key", "piece_no", "start", "stop", "piece"])

    return run


def _check(limit: int, overlap: int) -> None:
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and less than half the limit")


def split_texts(docs: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, range_chars: int | None = None) -> DataFrame:
    """(key, piece_no, start, stop, piece) of every non-null text; ``start`` and ``stop`` are character offsets."""
    _check(limit, overlap)
    size = range_chars or max(RANGE, 2 * limit)
    if size < 2 * limit:
        raise ValueError("a range must hold at least two pieces")
    src = docs.select(docs[key].alias("key"), docs[text].alias("text")).where("text IS NOT NULL")
    kind = src.schema["key"].dataType.simpleString()
    long = src.where(F.length("text") > size).withColumn("item", F.sha2("text", 256))  # equal texts have equal seams
    bounds = long.select("item", "text").mapInArrow(_bounds(size, limit), "item string, range_no bigint, chars bigint, seam_chars bigint").distinct()
    each = F.struct(F.col("range_no").alias("no"), F.col("start_chars").alias("start"), F.col("stop_chars").alias("stop"))
    ranges = stitch(bounds, ["chars"]).groupBy("item").agg(F.array_sort(F.collect_list(each)).alias("ranges"))
    nothing = F.lit(None).cast("array<struct<no:bigint,start:bigint,stop:bigint>>")
    todo = src.where(F.length("text") <= size).select("key", "text", nothing.alias("ranges")).unionByName(long.join(ranges, "item").select("key", "text", "ranges"))
    return todo.mapInArrow(_emit(limit, overlap), f"key {kind}, piece_no bigint, start bigint, stop bigint, piece string").withColumnRenamed("key", key)


# Files -----------------------------------------------------------------------------------------------


def _read(path: str, low: int, high: int) -> bytes:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        return f.read_at(high - low, low)


def _code_point(data: bytes, at: int) -> int:
    """The first place from ``at`` on where no code point is under way."""
    end = min(at + 3, len(data))
    while at < end and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _text(data: bytes) -> str:
    """One character per code point or broken byte, so that lengths in bytes can be told from it."""
    return data.decode("utf-8", "surrogateescape")


def _size(text: str) -> int:
    return len(text.encode("utf-8", "surrogateescape"))


_BROKEN = re.compile("[\udc80-\udcff]")


def _file_bounds(limit: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halo = 4 * limit  # code points have four bytes at most
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for path, no, length in zip(*[b.column(c).to_pylist() for c in ("path", "range_no", "length")]):
                at, end = no * size, min(length, (no + 1) * size)
                low = max(0, at - halo)
                data = _read(path, low, min(length, end + halo))
                first, stop = _code_point(data, at - low) if no else 0, _code_point(data, end - low) if end < length else len(data)
                left, core = _text(data[_code_point(data, 0) if low else 0 : first])[-limit:], _text(data[first:stop])
                place = len(core) if end == length else seam(ends_of(left + core + _text(data[stop:])[:limit]), len(left) + len(core), limit) - len(left)
                for col, v in zip(out, (path, no, len(core), place, stop - first, _size(core[:place]))):
                    col.append(v)
            yield _batch(out, ["item", "range_no", "chars", "seam_chars", "bytes", "seam_bytes"], [pa.string(), *[pa.int64()] * 5])

    return run


def _file_pieces(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, no, start, stop, base in zip(*[b.column(c).to_pylist() for c in ("item", "range_no", "start_bytes", "stop_bytes", "start_chars")]):
                low = max(0, start - 4 * overlap - 3)
                data = _read(path, low, stop)
                left, core = _text(data[_code_point(data, 0) if low else 0 : start - low])[-overlap:] if overlap else "", _text(data[start - low :])
                text = left + core
                spans = list(cut(ends_of(text), len(left), len(text), limit, overlap, len(left)))
                offset = base - len(left)
                rows = [[path] * len(spans), [no] * len(spans), list(range(len(spans))), [offset + s for s, _ in spans], [offset + e for _, e in spans], [_BROKEN.sub("\ufffd", text[s:e]) for s, e in spans]]
                yield _batch(rows, ["item", "range_no", "local_no", "start", "stop", "piece"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()])

    return run


def file_boundaries(spark: SparkSession, paths: str, limit: int = LIMIT, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(item, range_no, start_chars, stop_chars, start_bytes, stop_bytes): the stitched boundary table of UTF-8 files.

    Only names and lengths are listed; each range is read by one task with its halo.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "length").where("length > 0")
    numbers = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / range_bytes))
    todo = files.select("path", "length", F.explode(numbers).alias("range_no")).repartition("path", "range_no")
    cols = "item string, range_no bigint, chars bigint, seam_chars bigint, bytes bigint, seam_bytes bigint"
    return stitch(todo.mapInArrow(_file_bounds(limit, range_bytes), cols), ["chars", "bytes"])


def split_files(spark: SparkSession, paths: str, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, piece_no, start, stop, piece) of UTF-8 files of any size, read by byte ranges; offsets are in characters."""
    _check(limit, overlap)
    if range_bytes < 8 * limit:
        raise ValueError("a range must hold at least two pieces")
    table = file_boundaries(spark, paths, limit, range_bytes).repartition("item", "range_no")
    cols = "item string, range_no bigint, local_no bigint, start bigint, stop bigint, piece string"
    pieces = materialise(table.mapInArrow(_file_pieces(limit, overlap), cols), "pieces")
    counts = pieces.groupBy("item", "range_no").agg(F.count("*").alias("n")).withColumn("seam_n", F.col("n"))
    numbered = pieces.join(stitch(counts, ["n"]).select("item", "range_no", "start_n"), ["item", "range_no"])
    return numbered.select(F.col("item").alias("path"), (F.col("start_n") + F.col("local_no")).alias("piece_no"), "start", "stop", "piece")
