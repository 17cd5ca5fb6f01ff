"""Garbled text from wrong character encodings (problem 3).

Round-trip repair: the part of a text that a wrong decoding could have produced
is encoded again with the encoding it was probably read with and strictly
decoded with the one it was probably written in. A repair is kept when the
garbling cost of the text drops, and is tried again on its result, since text
may have been garbled more than once.

Four families are tried, each on stretches only, so that the sound text around
a garbled stretch stays as it is:

* UTF-8 read with a single-byte encoding: every multi-byte UTF-8 sequence shows
  up as a lead character followed by continuation characters of that encoding;
* a two-byte East Asian encoding read with a single-byte one: runs of upper
  characters decode to ordinary syllables or kana;
* UTF-8 read with a two-byte East Asian encoding: runs of rare syllables and
  ideographs encode to valid UTF-8;
* a two-byte East Asian encoding read as UTF-8: most bytes are lost, pairs that
  happen to be a UTF-8 sequence decode to ordinary syllables or kana.

Layers are undone until the cost stops falling, however many there are: it
falls by a fixed step at least each time, so this ends.

Bytes a decoder could not read are lost (U+FFFD) and stay marked; a character
that lacks a byte becomes one mark. A field of marks that no repair explains is
a case if a round trip does: legacy letters put in their place, encoded in that
legacy encoding and read as UTF-8, give the field again, and cost less.

Defined results: null and empty texts are sound; a repeated row is judged like
its copy; a text of any length is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame

LOST = "�"
SINGLE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1254", "cp1253", "iso8859_15", "koi8_r", "cp866")
#: Two-byte encodings and the bytes of their ordinary characters.
DOUBLE = ("cp949", "euc_jp", "cp932")
WIDE = ("cp949", "cp932", "gb18030", "big5")
CONTROL = re.compile("[\u0080-\u0084\u0086-\u009f]")
HANGUL = re.compile("[가-힣]")
KANA = re.compile("[぀-ヿ]")
_KANJI = re.compile("[一-龥]")


def _char(byte: int, codec: str) -> str:
    """What ``codec`` shows for a byte; bytes it leaves undefined pass as control characters."""
    try:
        return bytes([byte]).decode(codec)
    except UnicodeDecodeError:
        return chr(byte)


@lru_cache(maxsize=None)
def _table(codec: str) -> tuple[dict[str, int], re.Pattern]:
    """Upper half of a single-byte encoding and the look of UTF-8 sequences in it."""
    chars = {b: _char(b, codec) for b in range(0x80, 0x100)}
    cls = lambda lo, hi: "[" + "".join(re.escape(chars[b]) for b in range(lo, hi + 1)) + "]"
    tail = cls(0x80, 0xBF)[:-1] + LOST + "]"
    rx = f"(?:{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{{2}}|{cls(0xF0, 0xF4)}{tail}{{3}})+"
    return {c: b for b, c in chars.items()}, re.compile(rx)


@lru_cache(maxsize=None)
def _strange() -> str:
    """Characters, as the inside of a class, that sound text of the expected languages hardly has.

    A character is expected if a usual encoding of those languages has it, so
    rare syllables, rare ideographs and foreign scripts all count as strange.
    """
    expected = {ord(c) for c in "∂≈√≥≤≠∞′″−"}
    for codec in ("latin-1", "cp1252", "euc_kr", "shift_jis", "cp1253", "cp1251"):
        for point in range(0x80, 0x10000):
            try:
                if len(chr(point).encode(codec)) <= 2:  # longer ones spell out syllables that the encoding lacks
                    expected.add(point)
            except UnicodeEncodeError:
                pass
    strange, start = "", None
    for point in range(0x80, 0x10001):
        out = point < 0x10000 and point not in expected and point != 0xFFFD and not 0xD800 <= point <= 0xDFFF
        if out and start is None:
            start = point
        elif not out and start is not None:
            strange += f"\\u{start:04x}-\\u{point - 1:04x}"
            start = None
    return strange


_SHAPES = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250")
_ALONE = "\\u0080-\\u009f\\u2500-\\u259f\\ue000-\\uf8ff\\u3131-\\u318e\\uff61-\\uff9f"


@lru_cache(maxsize=None)
def _quick() -> re.Pattern:
    """Matches in every text whose cost isn't zero, and in few others; much faster than the cost."""
    chars = lambda lo, hi: "".join(re.escape(_char(b, c)) for c in _SHAPES for b in range(lo, hi + 1))
    return re.compile(f"[{_ALONE}{LOST}{_strange()}]|[{chars(0xC2, 0xF4)}][{chars(0x80, 0xBF)}]|[\\u00a1-\\u00ff]{{2}}")


@lru_cache(maxsize=None)
def _odd() -> re.Pattern:
    """Looks that sound text hardly has; the group's name gives the weight."""
    strange = _strange()
    shapes = "|".join(_table(c)[1].pattern for c in _SHAPES)
    return re.compile(
        f"(?P<utf8>{shapes})|(?P<lost>{LOST}+)|(?P<ctrl>[\\u0080-\\u009f]+)|(?P<boxes>[\\u2500-\\u259f]+)|(?P<private>[\\ue000-\\uf8ff]+)"
        f"|(?P<jamo>[\\u3131-\\u318e]+)|(?P<half>[\\uff61-\\uff9f]+)|(?P<upper>[\\u00a1-\\u00ff]{{2,}})|(?P<strange>[{strange}]+)"
    )


_WEIGHT = {"utf8": 1.5, "lost": 2.0, "ctrl": 3.0, "boxes": 2.0, "private": 3.0, "jamo": 1.5, "half": 1.5, "upper": 1.0, "strange": 3.0}


def cost(text: str) -> float:
    """How garbled a text looks: lost and control characters, shapes of UTF-8, strange characters."""
    return sum(_WEIGHT[m.lastgroup] * len(m.group()) for m in _odd().finditer(text))


def _utf8_in_single(text: str, codec: str) -> str:
    """``text`` with every stretch decoded that shows UTF-8 read as ``codec``."""
    table, rx = _table(codec)

    def fix(m: re.Match) -> str:
        raw = m.group()
        if LOST not in raw:
            try:
                return bytes(table[c] for c in raw).decode("utf-8")
            except UnicodeDecodeError:
                return raw
        # A sequence with a lost byte can't be restored; it is one lost character.
        return bytes(table.get(c, 0xFF) for c in raw).decode("utf-8", "replace")

    return rx.sub(fix, text)


#: Upper characters of the single-byte encodings that two-byte text is mostly read with.
_UPPER = "\u0080-ÿŒœŠšŽžŸƒˆ˜–—‘’‚“”„†‡•…‰‹›€™"
_RUN = re.compile(f"[{_UPPER}]{{2,}}(?:[A-Za-z]?[{_UPPER}]+)*")
_PLAIN = {"cp949": re.compile("[가-힣]+"), "euc_jp": re.compile("[぀-ヿ一-龥、。「」ー]+"), "cp932": re.compile("[぀-ヿ一-龥、。「」ー]+")}
#: Other characters of such a text; no evidence by themselves.
_SIGNS = re.compile("[一-龥가-힣±°·×]+")
#: Fewer characters than this, in runs apart from Latin letters, are no evidence of two-byte text.
_LEAST_RUN = 2


def _double_in_single(text: str, read_as: str, written: str) -> str:
    """``text`` with its runs decoded that show ``written`` read as ``read_as``, if they hold enough."""
    table, _ = _table(read_as)
    apart, runs = 0, []
    for m in _RUN.finditer(text):
        try:
            new = bytes(table.get(c, ord(c)) for c in m.group()).decode(written)
        except (UnicodeDecodeError, ValueError):
            continue
        if sum(map(len, _PLAIN[written].findall(new))) < 0.75 * len(new):
            if _SIGNS.fullmatch(new):
                runs.append((m, new))
            continue
        beside = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
        if LOST in beside:
            continue
        if written == "cp949":
            apart += len(new) * (not any(map(str.isalpha, beside)))
        else:
            apart += len(new) * bool(KANA.search(new))
        runs.append((m, new))
    if apart < _LEAST_RUN:
        return text
    out, at = [], 0
    for m, new in runs:
        out += [text[at : m.start()], new]
        at = m.end()
    return "".join([*out, text[at:]])


_EAST = re.compile("[\u0080¡-ÿ　-鿿가-힣豈-﫿＀-￯∀-⋿▀-◿←-⇿Ͱ-ϿЀ-ӿ─-╿ℂ-⅏①-⓿�–-…]+")


def _with_gaps(data: bytes) -> str | None:
    """UTF-8 in which 0xFF stands for a lost byte: a character that lacks one is one mark; None if the rest isn't UTF-8."""
    out, i = [], 0
    while i < len(data):
        lead = data[i]
        if lead < 0x80:
            out.append(chr(lead))
            i += 1
            continue
        size = 3 if lead == 0xFF or 0xE0 <= lead < 0xF0 else 2 if 0xC2 <= lead < 0xE0 else 4 if 0xF0 <= lead < 0xF5 else 0
        end = i + 1
        while end < min(len(data), i + size) and (0x80 <= data[end] < 0xC0 or data[end] == 0xFF):
            end += 1
        if not size or (lead != 0xFF and end < i + size):
            return None
        part = data[i:end]
        if 0xFF in part:
            out.append(LOST)
        else:
            try:
                out.append(part.decode("utf-8"))
            except UnicodeDecodeError:
                return None
        i = end
    return "".join(out)


def _wide_bytes(raw: str, codec: str) -> bytes:
    data = bytearray()
    for c in raw:
        try:
            data += c.encode(codec)
        except UnicodeEncodeError:
            data += bytes([ord(c)]) if ord(c) < 0x100 else b"\xff"
    return bytes(data)


def _utf8_in_wide(text: str, codec: str) -> str:
    """``text`` with its runs decoded that show UTF-8 read with a two-byte encoding; gaps are read where whole characters decode too."""
    whole, gaps, kept = [], [], 0
    for m in _EAST.finditer(text):
        if len(m.group()) < 2:
            continue
        data = _wide_bytes(m.group(), codec)
        new = _with_gaps(data)
        if new is None:
            continue
        kept += len(HANGUL.findall(new)) + len(KANA.findall(new)) + len(_KANJI.findall(new))
        (gaps if LOST in new else whole).append((m.start(), m.end(), new))
    out, at = [], 0
    for start, end, new in sorted(whole + gaps if kept >= 2 else whole):
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


_LOSSY = re.compile(f"[{LOST}\u0080-\u07ff]{{2,}}")


def _double_in_utf8(text: str, written: str) -> str:
    """``text`` with the pairs decoded that survived when ``written`` was read as UTF-8; two lost bytes are one mark."""
    if LOST not in text:
        return text
    good, all_ = 0, 0

    def fix(m: re.Match) -> str:
        nonlocal good, all_
        if LOST not in m.group():
            return m.group()
        data = [b for c in m.group() for b in ([None] if c == LOST else c.encode())]
        out = []
        for i in range(0, len(data), 2):
            pair = data[i : i + 2]
            if None in pair or len(pair) < 2:
                out.append(LOST)
                continue
            all_ += 1
            try:
                out.append(bytes(pair).decode(written))
                good += pair[0] > 0xC2 and bool(_PLAIN[written].fullmatch(out[-1]))  # 0xC2 leads signs like the degree's
            except UnicodeDecodeError:
                out.append(LOST)
        return "".join(out)

    new = _LOSSY.sub(fix, text)
    return new if good and good >= 0.75 * all_ else text


@lru_cache(maxsize=None)
def _repairs() -> tuple:
    return (
        *[partial(_utf8_in_single, codec=c) for c in SINGLE],
        *[partial(_double_in_single, read_as=r, written=w) for r in ("cp1252", "latin-1") for w in DOUBLE],
        *[partial(_utf8_in_wide, codec=c) for c in WIDE],
        *[partial(_double_in_utf8, written=w) for w in ("cp949", "euc_jp")],
    )


def _settled(repair, text: str) -> str:
    """The repair applied as long as it shortens the text, once per layer."""
    while len(new := repair(text)) < len(text):
        text = new
    return new


def restore(text: str) -> str:
    """The text with every repair that lowers its garbling cost; itself if there is none."""
    if text.isascii() or not _quick().search(text):
        return text
    now = cost(text)
    while now > 0:
        best, least = text, now
        for repair in _repairs():
            if least > 0 and (new := _settled(repair, text)) != text and (c := cost(new)) < least:
                best, least = new, c
        if best == text:
            break
        text, now = best, least
    return text


def explained(text: str) -> bool:
    """Lost characters are those of a legacy text read as UTF-8: with a legacy letter for each, the round trip gives the text again and the cost drops."""
    if LOST not in text:
        return False
    for codec, letter in (("cp1252", "é"), ("cp949", "가"), ("euc_jp", "あ"), ("cp1251", "ж")):
        byte = letter.encode(codec)[:1]
        back = b"".join(byte if c == LOST else c.encode("utf-8", "surrogatepass") for c in text)
        if back.decode("utf-8", "replace") == text and cost(text.replace(LOST, letter)) < cost(text):
            return True
    return False


def judge(text: str | None) -> tuple[bool, str | None]:
    """Whether the text is garbled, and what could be restored."""
    if not text or text.isascii():
        return False, text
    new = restore(text)
    return new != text or explained(text) or bool(CONTROL.search(text)), new


def _fields(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, field, before, after = [], [], [], []
            key = b.column("key").to_pylist()
            for name in names:
                for k, text in zip(key, b.column(f"f_{name}").to_pylist()):
                    bad, new = judge(text)
                    if bad:
                        keys.append(k)
                        field.append(name)
                        before.append(text)
                        after.append(new)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field("key").type), *[pa.array(x, pa.string()) for x in (field, before, after)]], names=["key", "field_name", "garbled", "restored"])

    return run


def garbled_fields(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, garbled, restored) of every affected field."""
    src = docs.select(docs[key].alias("key"), *[docs[f].alias(f"f_{f}") for f in fields])
    kind = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(_fields(fields), f"key {kind}, field_name string, garbled string, restored string").withColumnRenamed("key", key)
