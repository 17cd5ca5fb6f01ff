"""Union-find over the edges that one task holds, in bounded chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 100_000


def union_find(pairs_a: list[int], pairs_b: list[int], n: int) -> list[int]:
    """Smallest member of each vertex's component; path halving, smaller root wins."""
    parent = list(range(n))
    for a, b in zip(pairs_a, pairs_b):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    for v in range(n):  # parents are smaller than children, so theirs are final
        parent[v] = parent[parent[v]]
    return parent


def _star_forest(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(held)
    enc = pc.dictionary_encode(pa.concat_arrays([*t.column("u").chunks, *t.column("v").chunks]))
    words, codes = enc.dictionary, enc.indices.to_numpy()
    order = pc.sort_indices(words).to_numpy()
    place = np.empty(len(words), dtype=np.int64)
    place[order] = np.arange(len(words))
    codes = place[codes]
    half = len(codes) // 2
    root = np.array(union_find(codes[:half].tolist(), codes[half:].tolist(), len(words)), dtype=np.int64)
    child = np.flatnonzero(root != np.arange(len(words)))
    words = words.take(pa.array(order))
    return pa.RecordBatch.from_arrays([words.take(pa.array(child)), words.take(pa.array(root[child]))], names=["u", "v"])


def star_forest(chunk: int = CHUNK) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For edges (u, v): each chunk's vertices linked to the smallest one they are connected with there.

    The components stay what they are, whatever edges a chunk holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= chunk:
                yield _star_forest(held)
                held, rows = [], 0
        if held:
            yield _star_forest(held)

    return run
