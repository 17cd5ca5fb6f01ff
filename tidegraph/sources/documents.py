"""Readers of documents: plain text, Markdown, HTML, CSV and zipped office files."""

from __future__ import annotations

import html as _html
import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

KINDS = {"md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "csv": "csv", "pdf": "pdf", "hwp": "hwp", "docx": "docx", "pptx": "pptx"}


def kind_of(path: Column) -> Column:
    """The kind of a file by its ending; unknown endings, .json and .xml are text."""
    ending = F.regexp_extract(F.lower(path), "\\.([a-z0-9]+)$", 1)
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.coalesce(known[ending], F.lit("text"))


@pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else _html.unescape(t))


_BLOCK = "(?:p|div|br|li|tr|h[1-6]|table|section|article|ul|ol)"


def html_text(c: Column) -> Column:
    """Text of a page: scripts and styles gone, block ends as line ends, tags dropped, entities read."""
    bare = F.regexp_replace(c, "(?is)<(script|style)\\b[^>]*>.*?</\\1\\s*>", "")
    lines = F.regexp_replace(bare, f"(?i)</{_BLOCK}\\s*>|<br\\s*/?>", "\n")
    plain = F.regexp_replace(lines, "<[^>]+>", "")
    read = F.when(plain.contains("&"), unescape(plain)).otherwise(plain)
    return F.regexp_replace(F.regexp_replace(read, "\n{3,}", "\n\n"), "^\\s+|\\s+$", "")


def html_title(c: Column) -> Column:
    """The title element, else the first heading; null without either."""
    pick = lambda rx: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(c, rx, 1), "<[^>]+>", "")), F.lit(""))
    return F.coalesce(pick("(?is)<title[^>]*>(.*?)</title>"), pick("(?is)<h[12][^>]*>(.*?)</h[12]>"))


def html_meta(c: Column, name: str) -> Column:
    """Content of a meta tag of that name or property; null without one."""
    a = F.regexp_extract(c, f"(?is)<meta[^>]+(?:name|property)\\s*=\\s*[\"']{re.escape(name)}[\"'][^>]*content\\s*=\\s*[\"']([^\"']*)[\"']", 1)
    b = F.regexp_extract(c, f"(?is)<meta[^>]+content\\s*=\\s*[\"']([^\"']*)[\"'][^>]*(?:name|property)\\s*=\\s*[\"']{re.escape(name)}[\"']", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def html_links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?is)<a\\b[^>]*href\\s*=\\s*[\"']([^\"'#][^\"']*)[\"']"), 1)


def paper(c: Column) -> Column:
    """Record of a paper page: citation tags, else what the page shows."""
    return F.struct(
        F.coalesce(html_meta(c, "citation_title"), html_title(c)).alias("title"),
        F.split(F.coalesce(html_meta(c, "citation_author"), html_meta(c, "author"), F.lit("")), "\\s*;\\s*").alias("authors"),
        F.coalesce(html_meta(c, "citation_abstract"), html_meta(c, "description")).alias("abstract"),
        F.coalesce(html_meta(c, "citation_publication_date"), html_meta(c, "citation_date")).alias("issued"),
        html_meta(c, "citation_doi").alias("doi"),
        html_meta(c, "citation_journal_title").alias("journal"),
    )


_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_UNDERLINE = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]+|$)")
_QUOTE = re.compile(r"(?: {0,3}> ?)+")
_CLOSING = re.compile(r"(?:^|[ \t]+)#+[ \t]*$")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _blocks(text: str) -> Iterator[str]:
    """Lines of a document without what marks its blocks: fenced code, headings, quotes, rules."""
    fence, paragraph = "", False
    for line in text.split("\n"):
        line = _QUOTE.sub("", line.rstrip("\r"), count=1) if _QUOTE.match(line) else line.rstrip("\r")
        m = _FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line[m.end() :].strip():
                fence = ""
            continue
        if m:
            fence, paragraph = m[1], False
        elif paragraph and _UNDERLINE.match(line):
            paragraph = False
        elif _RULE.match(line):
            paragraph = False
            yield ""
        elif h := _HEADING.match(line):
            paragraph = False
            yield _CLOSING.sub("", line[h.end() :])
        else:
            paragraph = bool(line.strip())
            yield line


def _bracket(text: str, at: int, opening: str, closing: str) -> int:
    """Where the bracket that opens at ``at`` closes; -1 if it doesn't."""
    depth, i = 0, at
    while i < len(text):
        if text[i] == "\\":
            i += 1
        elif text[i] == opening:
            depth += 1
        elif text[i] == closing:
            depth -= 1
            if not depth:
                return i
        i += 1
    return -1


def _inline(text: str) -> str:
    """Text of a paragraph: code spans, images and links give their text, emphasis its words."""
    out: list[str] = []
    marks: list[tuple[int, str, int, bool, bool]] = []  # place in out, mark, length, opens, closes
    i = 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and text[i + 1] in _PUNCTUATION:
            out.append(text[i + 1])
            i += 2
            continue
        if c == "`":
            run = len(text) - i - len(text[i:].lstrip("`"))
            end = re.compile(rf"(?<!`)`{{{run}}}(?!`)").search(text, i + run)
            out.append(text[i + run : end.start()] if end else "`" * run)
            i = end.end() if end else i + run
            continue
        label = i + 1 if c == "!" and text[i + 1 : i + 2] == "[" else i if c == "[" else -1
        if label >= 0 and (close := _bracket(text, label, "[", "]")) > 0 and text[close + 1 : close + 2] == "(" and (end := _bracket(text, close + 1, "(", ")")) > 0:
            out.append(_inline(text[label + 1 : close]))
            i = end + 1
            continue
        if c in "*_":
            run = len(text) - i - len(text[i:].lstrip(c))
            before, after = text[i - 1 : i] or " ", text[i + run : i + run + 1] or " "
            left = not after.isspace() and (after.isalnum() or not before.isalnum())
            right = not before.isspace() and (before.isalnum() or not after.isalnum())
            opens, closes = (left, right) if c == "*" else (left and not (right and before.isalnum()), right and not (left and after.isalnum()))
            marks.append((len(out), c, run, opens, closes))
            out.append(c * run)
            i += run
            continue
        out.append(c)
        i += 1
    open_: list[list] = []  # place, mark, marks left, length of the run, whether it may close too
    fit = lambda o, c, run, both: o[1] == c and not ((o[4] or both) and (o[3] + run) % 3 == 0 and (o[3] % 3 or run % 3))
    for place, c, run, opens, closes in marks:
        left = run
        while closes and left:
            k = next((k for k in range(len(open_) - 1, -1, -1) if fit(open_[k], c, run, opens and closes)), -1)
            if k < 0:
                break
            used = min(2, left, open_[k][2])
            left -= used
            open_[k][2] -= used
            del open_[k + 1 :]
            out[open_[k][0]] = c * open_[k][2]
            if not open_[k][2]:
                del open_[k]
        out[place] = c * left
        if opens and left:
            open_.append([place, c, left, run, closes])
    return "".join(out)


def plain_markdown(text: str) -> str:
    """Markdown without its marks, read by the rules of CommonMark; fenced code is left out, list marks stay."""
    paragraphs = re.split(r"\n[ \t]*\n", "\n".join(_blocks(text)))
    return re.sub("\n{3,}", "\n\n", "\n\n".join(map(_inline, paragraphs))).strip()


@pandas_udf(StringType())
def markdown_text(c: pd.Series) -> pd.Series:
    return c.map(lambda t: None if t is None else plain_markdown(t))


def markdown_title(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, "(?m)^#\\s+(.+)$", 1)), F.lit(""))


def links(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, link) of plain links in a text."""
    return df.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit("https?://[A-Za-z0-9./?=&_-]+"), 0)).alias("link"))


def page_parts(df: DataFrame, html: str, mode: str = "all", text_limit: int | None = None, html_limit: int | None = None) -> DataFrame:
    """Text, source and links of crawled pages, whole unless the caller asks for at most so many characters."""
    cut = lambda c, n: c if n is None else F.substring(c, 1, n)
    out = df
    if mode in ("text", "all"):
        out = out.withColumn("text", cut(F.regexp_replace(html_text(F.col(html)), "\\s+", " "), text_limit))
    if mode in ("html", "all"):
        out = out.withColumn("source", cut(F.col(html), html_limit))
    if mode in ("links", "all"):
        out = out.withColumn("links", html_links(F.col(html)))
    return out


def csv_document(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, rows, columns): a CSV file as one text, fields between tabs, rows on lines."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for f in frames:
            parsed = [list(csv.reader(io.StringIO(t))) for t in f["text"]]
            yield pd.DataFrame({"path": f["path"], "text": ["\n".join("\t".join(r) for r in p) for p in parsed], "rows": [len(p) for p in parsed], "columns": [max(map(len, p), default=0) for p in parsed]})

    return whole.mapInPandas(run, "path string, text string, rows int, columns int")


_XML_TEXT = re.compile(r"<(?:w|a):t(?:\s[^>]*)?>([^<]*)</(?:w|a):t>")
_XML_PARAGRAPH = re.compile(r"</(?:w|a):p>")


def office_text(data: bytes) -> str | None:
    """Text of a .docx or .pptx file, read from its XML; null if it isn't one."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            slide = lambda n: int(re.sub(r"\D", "", n) or 0)
            names = [n for n in z.namelist() if n == "word/document.xml"] or sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=slide)
            if not names:
                return None
            pages = []
            for n in names:
                parts = _XML_PARAGRAPH.split(z.read(n).decode("utf-8", "replace"))
                pages.append("\n".join(t for p in parts if (t := "".join(_html.unescape(x) for x in _XML_TEXT.findall(p))).strip()))
            return "\n\n".join(pages)
    except (zipfile.BadZipFile, KeyError, OSError):
        return None


def office_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of .docx and .pptx files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "text": [office_text(bytes(c)) for c in f["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


class Readers:
    """Column functions by kind of document; others can be registered."""

    def __init__(self) -> None:
        same = lambda c: c
        self.by_kind: dict[str, Callable[[Column], Column]] = {"text": same, "csv": same, "markdown": markdown_text, "html": html_text}

    def register(self, kind: str, reader: Callable[[Column], Column]) -> "Readers":
        self.by_kind[kind] = reader
        return self

    def read(self, content: Column, kind: Column) -> Column:
        """The text of each row by its kind; null for a kind without a reader."""
        out = F.lit(None).cast("string")
        for k, reader in self.by_kind.items():
            out = F.when(kind == k, reader(content)).otherwise(out)
        return out
