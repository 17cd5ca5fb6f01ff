"""Encoding of the whole corpus with a public tokenizer (problem 7).

Texts of up to ``leaf`` characters are encoded in one piece where they lie.
Longer texts are cut into leaves that are encoded in parallel, whatever tokens
the cuts fall into, and joined again in a tree. A join re-encodes a window
around its seam and grows it until both sides agree:

* either the window reaches, on each side, a place where a letter or digit is
  followed by a plain blank or mark. The public pattern starts a new word at
  every such place, from wherever it is applied, so the tokens outside the
  window are those of the whole text;
* or the seam lies inside one unbroken run of letters, and the window's tokens
  are compatible with their neighbours on both sides: a byte-pair encoding of
  one word is valid exactly when every two adjacent tokens, put together,
  encode to themselves.

Defined results: null and empty texts have an empty list; strings that look
like special tokens are ordinary text; repeated rows each get their ids; long
texts that occur repeatedly are encoded once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF = 8192
FAN_IN = 8
WINDOW = 32

#: A letter or digit before a plain blank or mark: a word of the pattern always ends here.
_CERTAIN = regex.compile(r"[\p{L}\p{N}](?=[ \n.,;:!?()\-、。])")
_LETTERS = regex.compile(r"\p{L}+")


class Codec:
    """A public vocabulary read from ``path``."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.enc.encode_ordinary(text)

    def bytes(self, ids) -> bytes:
        return self.enc.decode_bytes(list(ids))

    def agree(self, x: int, y: int) -> bool:
        """x and y may stand side by side inside one word."""
        return self.enc._encode_single_piece(self.bytes([x, y])) == [x, y]

    def _at_word_ends(self, left: bytes, right: bytes) -> tuple[int, int] | None:
        """Bytes of the tail of ``left`` and of the head of ``right`` within certain word ends."""
        lt, rt = left.decode("utf-8", "replace"), right.decode("utf-8", "replace")
        found = list(_CERTAIN.finditer(lt))
        ahead = _CERTAIN.search(rt)
        if not found or not ahead:
            return None
        tail, head = lt[found[-1].end() :], rt[: ahead.end()]
        if "�" in tail or "�" in head:
            return None
        return len(tail.encode()), len(head.encode())

    def _inside_word(self, left: list[int], right: list[int], a: int, b: int) -> list[int] | None:
        lo, hi = max(0, a - WINDOW), min(len(right), b + WINDOW)
        if a == 0 or b == len(right) or not _LETTERS.fullmatch(self.bytes([*left[lo:], *right[:hi]]).decode("utf-8", "ignore")):
            return None
        mid = self.enc._encode_single_piece(self.bytes([*left[a:], *right[:b]]))
        return mid if self.agree(left[a - 1], mid[0]) and self.agree(mid[-1], right[b]) else None

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of the text of ``left`` followed by that of ``right``."""
        if not left or not right:
            return [*left, *right]
        w = WINDOW
        while w < len(left) or w < len(right):
            a, b = max(0, len(left) - w), min(len(right), w)
            lb, rb = self.bytes(left[a:]), self.bytes(right[:b])
            if ends := self._at_word_ends(lb, rb):
                la, ra = self._prefix(left, len(lb) - ends[0], a), self._prefix(right, ends[1], 0)
                if la is not None and ra is not None:
                    mid = lb[len(lb) - ends[0] :] + rb[: ends[1]]
                    return [*left[:la], *self.encode(mid.decode()), *right[ra:]]
            elif (mid := self._inside_word(left, right, a, b)) is not None:
                return [*left[:a], *mid, *right[b:]]
            w *= 2
        return self.encode(self.bytes([*left, *right]).decode())

    def _prefix(self, ids: list[int], size: int, start: int) -> int | None:
        """Index of the token that begins ``size`` bytes after token ``start``."""
        at, i = 0, start
        while at < size:
            at += len(self.enc.decode_single_token_bytes(ids[i]))
            i += 1
        return i if at == size else None


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _encode(path: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                ids = pa.array([c.encode(t) if t else [] for t in s.column("text").to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*[s.column(k) for k in keep], ids], names=[*keep, "ids"])

    return run


def _leaves(leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, text in zip(b.column("h").to_pylist(), b.column("text").to_pylist()):
                parts = [text[i : i + leaf] for i in range(0, len(text), leaf)]
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(parts)), pa.array(range(len(parts)), pa.int64()), pa.array(parts)], names=["h", "node", "text"])

    return run


def _merge(path: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = codec(path)
        pdf = pdf.sort_values("node")
        parts = [x.tolist() for x in pdf["ids"]]
        while len(parts) > 1:
            parts = [c.join(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return pd.DataFrame({"h": [pdf["h"].iat[0]], "node": [int(pdf["node"].iat[0]) // FAN_IN], "ids": [np.array(parts[0], dtype=np.int32)]})

    return run


def encode_corpus(docs: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """(key, ids array<int>): the ids of every text, without special tokens."""
    src = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    size = F.length("text")
    whole = src.where(size.isNull() | (size <= leaf)).mapInArrow(_encode(vocabulary, ["key"]), f"key {kind}, ids array<int>")
    long = src.where(size > leaf).withColumn("h", F.sha2("text", 256))
    deepest = long.agg(F.max(F.length("text"))).first()[0]
    if not deepest:
        return whole.withColumnRenamed("key", key)
    nodes = (
        long.select("h", "text")
        .dropDuplicates(["h"])
        .mapInArrow(_leaves(leaf), "h string, node bigint, text string")
        .repartition("h", "node")
        .mapInArrow(_encode(vocabulary, ["h", "node"]), "h string, node bigint, ids array<int>")
    )
    width = -(-deepest // leaf)
    while width > 1:
        nodes = nodes.groupBy("h", F.floor(F.col("node") / FAN_IN).alias("parent")).applyInPandas(_merge(vocabulary), "h string, node bigint, ids array<int>")
        width = -(-width // FAN_IN)
    return whole.unionByName(long.select("key", "h").join(nodes.select("h", "ids"), "h").select("key", "ids")).withColumnRenamed("key", key)
