"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors. A vector is known by the order of its nearest pivots. The index is cut into
blocks of rows; in each, every pivot has an inverted file: the rows that have it among their nearest pivots, and at which
place. A query opens the files of its own nearest pivots, ranks the rows it meets there by Spearman's footrule (a pivot
that one side lacks counts as placed last) and measures the exact cosine of the best of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .common import named

#: Pivots at most; they are chosen among the SAMPLE vectors of least hash, so what the driver sees is bounded.
PIVOTS, SAMPLE = 512, 2048
#: Share of the pivots that a permutation keeps.
KEPT = 8
#: Rows of a block of the index and queries of a block of queries.
BLOCK_ROWS, QUERY_ROWS = 4096, 2048
#: Of each block, the share whose cosine is measured, and the least number of rows.
RERANK, RERANK_LEAST = 0.12, 256


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>), without rows that have no id or whose vector is null, zero or not finite throughout. An id counts once."""
    d = named(vectors, vec_id=vec_id, v=vector).withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = d.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    return d.groupBy("vec_id").agg(F.min("v").alias("v"))


def choose_pivots(vectors: DataFrame) -> np.ndarray:
    """Different unit vectors out of a fixed sample, at most PIVOTS of them."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    unit = np.array([r["v"] for r in rows])
    unit = unit / np.abs(unit).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    _, first = np.unique(unit.round(9), axis=0, return_index=True)
    return unit[np.sort(first)[:PIVOTS]]


def permutations(unit: np.ndarray, pivots: np.ndarray, kept: int) -> np.ndarray:
    """For each row the numbers of its `kept` nearest pivots, nearest first, ties to the smaller number."""
    return np.argsort(-(unit @ pivots.T).round(12), axis=1, kind="stable")[:, :kept].astype(np.int16)


class Block:
    """The inverted files of one block of rows, ordered by id."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, order: np.ndarray, pivots: int):
        self.ids, self.v, self.kept = ids, v, order.shape[1]
        self.norm = _norms(v)
        pivot, row = order.ravel(), np.repeat(np.arange(len(ids)), self.kept)
        place = np.tile(np.arange(self.kept, dtype=np.int32), len(ids))
        by = np.argsort(pivot, kind="stable")
        self.row, self.place = row[by], place[by]
        self.start = np.searchsorted(pivot[by], np.arange(pivots + 1))

    def nearest(self, query_id: int, q: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        nearer = np.zeros(len(self.ids), np.int32)  # by how much the footrule is below that of rows sharing no pivot
        for at, pivot in enumerate(order):
            span = slice(self.start[pivot], self.start[pivot + 1])
            # (kept - a) + (kept - b), were the pivot on one side only, less |a - b|
            nearer[self.row[span]] += 2 * (self.kept - np.maximum(self.place[span], at))
        nearer[self.ids == query_id] = -1
        take = min(len(self.ids), max(RERANK_LEAST, int(RERANK * len(self.ids))))
        best = np.argsort(-nearer, kind="stable")[:take]
        best = best[self.ids[best] != query_id]
        score = cosine(self.v[best], self.norm[best], q)
        top = np.lexsort((self.ids[best], -score))[:k]
        return self.ids[best[top]], score[top]


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=-1))


def cosine(v: np.ndarray, norm: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row alike, so that equal vectors have equal scores; huge or tiny components are scaled first."""
    scale = np.abs(q).max()
    s = np.abs(v).max(axis=1)
    if scale > 1e100 or scale < 1e-100 or (s > 1e100).any() or (s < 1e-100).any():
        v, q = v / s[:, None], q / scale
        norm = _norms(v)
    return (v * q).sum(axis=1) / (norm * _norms(q))


def nearest_neighbours(vectors: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by `every` its k nearest other rows that the index finds.

    Score is the cosine in double precision, ties go to the smaller id; with fewer other rows all of them are returned.
    Left out are rows without an id, vectors that are null, empty, zero, or hold null or non-finite components, and vectors
    of another length than the most common one. Repeated ids count once. An empty table gives no rows."""
    spark = vectors.sparkSession
    rows = store(usable(vectors, vec_id, vector))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == size["n"])
    pivots = choose_pivots(rows)
    kept = max(1, len(pivots) // KEPT)
    count = size["count"]
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    queries = rows.filter(is_query).count()
    parts, lots = -(-count // BLOCK_ROWS), max(1, -(-queries // QUERY_ROWS))

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = np.stack(pdf["v"].to_numpy())
            v = v / np.abs(v).max(axis=1, keepdims=True)
            yield pdf.assign(near=list(permutations(v / _norms(v)[:, None], pivots, kept)))

    indexed = store(rows.mapInPandas(order, "vec_id long, v array<double>, near array<short>"))
    hashed = F.xxhash64("vec_id")
    blocks = indexed.withColumn("part", F.pmod(hashed, F.lit(parts)).cast("int")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    asked = indexed.filter(is_query).withColumn("lot", F.pmod(hashed, F.lit(lots)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def search(block: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(block) and len(ask):
            block = block.sort_values("vec_id")
            held = Block(block["vec_id"].to_numpy(), np.stack(block["v"].to_numpy()), np.stack(block["near"].to_numpy()), len(pivots))
            for i, v, near in zip(ask["vec_id"], ask["v"], ask["near"]):
                ids, score = held.nearest(i, np.asarray(v), np.asarray(near), k)
                out.append(pd.DataFrame({"query_id": i, "vec_id": ids, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    found = blocks.groupBy("lot", "part").cogroup(asked.groupBy("lot", "part")).applyInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
