"""Vector tables: exact search in blocks, upsert, delete, metadata filters, an index registry."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.functions.text import cosine
from tidegraph.plans.scratch import materialise

#: Query vectors that a task multiplies a batch of rows with at a time.
BLOCK = 1024


def where_equal(metadata: str, where: dict[str, object] | None) -> Column:
    """All keys of ``where`` equal in a map column."""
    out = F.lit(True)
    for k, v in (where or {}).items():
        out = out & (F.col(metadata)[k] == F.lit(str(v)))
    return out


def search(vectors: DataFrame, query: list[float], top_k: int = 10, least: float | None = None) -> DataFrame:
    """(id, score) of the nearest rows by cosine; rows below ``least`` are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    out = vectors.select("id", cosine(F.col("embedding"), q).alias("score"))
    if least is not None:
        out = out.where(F.col("score") >= least)
    return out.orderBy(F.col("score").desc(), "id").limit(top_k)


def _unit(rows: list) -> np.ndarray:
    v = np.array(rows, dtype=np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _merge(best: list, ids: np.ndarray, scores: np.ndarray, top_k: int) -> list:
    """The best ``top_k`` (scores, ids) per query of those held and new ones; equal scores by id."""
    out = []
    for (held_s, held_i), s in zip(best, scores):
        low = np.partition(s, len(s) - top_k)[len(s) - top_k] if len(s) > top_k else -np.inf
        new = np.flatnonzero(s >= low)
        all_s, all_i = np.concatenate([held_s, s[new]]), np.concatenate([held_i, ids[new]])
        order = np.lexsort((all_i, -all_s))[:top_k]
        out.append((all_s[order], all_i[order]))
    return out


def search_many(vectors: DataFrame, queries: DataFrame, top_k: int = 10, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score, rank) of the nearest rows of ``vectors`` for every row of ``queries`` (id, embedding).

    Exact, and one plan whatever the number of queries: they are written once in
    the shared folder, every task reads them from there block by block for each
    batch of its vectors, and keeps the best ``top_k`` per query.
    """
    spark = vectors.sparkSession
    schema = f"query_id {queries.schema['id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    asked = materialise(queries.where("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<double>").alias("embedding")), "queries")
    where = asked._scratch_path

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.dataset as ds

        empty = (np.empty(0), np.empty(0, dtype=object))
        held: dict[int, tuple[list, list]] = {}  # block number -> (query ids, best per query)
        for f in frames:
            f = f[f["embedding"].notna()]
            for size, same in f.groupby(f["embedding"].map(len)):
                if not size:
                    continue
                names, v = same["id"].to_numpy(dtype=object), _unit(same["embedding"].tolist())
                for no, b in enumerate(ds.dataset(where, format="parquet").to_batches(batch_size=block)):
                    keys, vecs = b.column("id").to_pylist(), b.column("embedding").to_pylist()
                    ids, best = held.setdefault(no, (keys, [empty] * len(keys)))
                    fit = [i for i, x in enumerate(vecs) if len(x) == size]
                    if fit:
                        for i, got in zip(fit, _merge([best[i] for i in fit], names, _unit([vecs[i] for i in fit]) @ v.T, top_k)):
                            best[i] = got
        for ids, best in held.values():
            for at in range(0, len(ids), block):
                part = list(zip(ids[at : at + block], best[at : at + block]))
                yield pd.DataFrame({"query_id": [i for i, (s, _) in part for _ in s], "id": [x for _, (_, n) in part for x in n], "score": [x for _, (s, _) in part for x in s]})

    out = vectors.select("id", "embedding").mapInPandas(run, schema)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def upsert(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` in place of rows with the same id; of repeated new ids one stays."""
    one = new.dropDuplicates(["id"])
    return vectors.join(one.select("id"), "id", "left_anti").unionByName(one)


def delete(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("id").distinct(), "id", "left_anti")


def clear(vectors: DataFrame) -> DataFrame:
    return vectors.limit(0)


def to_embed(rows: DataFrame, fields: list[str], vector: str, least: int = 20) -> DataFrame:
    """Rows without a vector whose joined text has at least ``least`` characters, with that ``text``."""
    return rows.where(F.col(vector).isNull()).withColumn("text", F.concat_ws(" ", *fields)).where(F.length("text") >= least)


@dataclass(frozen=True)
class Index:
    name: str
    label: str
    property: str
    dimensions: int = 768
    similarity: str = "cosine"
    status: str = "created"
    rows: int = 0


class Indexes:
    """What vector indexes there are; the vectors stay in their tables."""

    def __init__(self) -> None:
        self._by_name: dict[str, Index] = {}

    def create(self, index: Index) -> Index:
        if index.name in self._by_name:
            raise ValueError(f"index {index.name!r} exists")
        if index.dimensions <= 0 or index.similarity not in ("cosine", "euclid", "dot"):
            raise ValueError("an index needs dimensions and a known similarity")
        self._by_name[index.name] = index
        return index

    def get(self, name: str) -> Index | None:
        return self._by_name.get(name)

    def all(self) -> list[Index]:
        return [self._by_name[k] for k in sorted(self._by_name)]

    def drop(self, name: str) -> bool:
        return self._by_name.pop(name, None) is not None

    def update(self, name: str, status: str, rows: int = 0) -> Index | None:
        if name in self._by_name:
            self._by_name[name] = replace(self._by_name[name], status=status, rows=rows)
        return self.get(name)
