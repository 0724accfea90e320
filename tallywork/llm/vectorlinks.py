"""Near duplicates among vectors by an epsilon grid order join.

Unit vectors whose cosine is c lie sqrt(2 - 2c) apart. They are turned onto their leading principal axes, sorted by the grid
cells (as wide as that distance) of these coordinates, and cut into intervals of the sequence. Every interval has a box of
its coordinates and of the length of what the axes leave over, and two boxes further apart than the distance hold no link.
Pairs of intervals are split and skipped from the whole sequence downwards, by joins of the boxes to blocks and within a
task from blocks to chunks; what remains is compared by matrix products, in doubles wherever single precision leaves doubt.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import named, numbered
from .components import components

#: Leading axes, fitted on the SAMPLE vectors of least hash, so that what the driver sees is bounded.
AXES, SAMPLE = 8, 2048
#: Vectors of a chunk at most, chunks of a block, and intervals that one of the next level up holds.
CHUNK, BLOCK, FAN = 256, 32, 8
#: Components of a chunk's vectors together.
CHUNK_NUMBERS = 16_384


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length 1. They are scaled by a power of two first, so that nothing overflows and no digit is lost."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, length: int) -> np.ndarray:
    """The leading principal axes (columns) of a bounded sample. Any orthonormal axes give the same links, these skip more."""
    rows = vectors.filter(F.size("v") == length).orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("v").collect()
    u = unit(np.array([r["v"] for r in rows], float))
    turned = np.linalg.eigh(np.cov(u.T.reshape(length, -1), bias=True).reshape(length, length))[1][:, ::-1]
    return np.ascontiguousarray(turned[:, : min(AXES, length)])


def coordinates(u: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """AXES coordinates and the length of the rest, a row for each vector."""
    if u.shape[1] != len(axes):  # a rarer length: its own first components
        axes = np.eye(u.shape[1])[:, : min(AXES, u.shape[1])]
    p = u @ axes
    rest = np.sqrt(np.maximum(0, 1 - (p * p).sum(axis=1)))
    return np.concatenate([p, np.zeros((len(u), AXES - p.shape[1])), rest[:, None]], axis=1)


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all components, where each row's start) of a column of lists."""
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])


def _same_lengths(starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.diff(starts)
    for length in np.unique(sizes).tolist():
        yield length, np.flatnonzero(sizes == length)


def placed(vectors: DataFrame, axes: np.ndarray) -> DataFrame:
    """Adds length, p0 .. p8: number of components and coordinates of each vector v."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, starts = _vectors(batch["v"])
            p = np.zeros((batch.num_rows, AXES + 1))
            for length, rows in _same_lengths(starts):
                p[rows] = coordinates(unit(flat[starts[rows][:, None] + np.arange(length)]), axes)
            yield pa.RecordBatch.from_arrays(
                [batch["least"], batch["copies"], batch["v"], pa.array(np.diff(starts).astype(np.int32)), *(pa.array(x) for x in p.T)],
                names=["least", "copies", "v", "length", *(f"p{k}" for k in range(AXES + 1))])

    kinds = ", ".join(f"p{k} double" for k in range(AXES + 1))
    return vectors.select("least", "copies", "v").mapInArrow(run, f"least long, copies long, v array<double>, length int, {kinds}")


def _corners() -> list[str]:
    return ["length", *(f"p{k}" for k in range(AXES + 1))]


def near_intervals(boxes: DataFrame, count: int, eps: float) -> DataFrame:
    """boxes(block, lo_x, hi_x of each coordinate x; blocks numbered from 0 to count - 1) -> a, b: pairs a <= b not provably further apart than eps.

    Starts with the whole sequence against itself; each level splits an interval into FAN and drops the pairs whose boxes are too far apart."""
    sides = [f"{end}_{c}" for c in _corners() for end in ("lo", "hi")]
    widths = [1]
    while widths[-1] < count:
        widths.append(widths[-1] * FAN)
    pairs = boxes.sparkSession.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for width in widths[-2::-1] or [1]:
        part = lambda c: F.explode(F.sequence(F.col(c) * FAN, F.least(F.col(c) * FAN + FAN - 1, F.lit((count - 1) // width))))
        if len(widths) > 1:
            pairs = pairs.select(part("a").alias("a"), "b").select("a", part("b").alias("b")).filter("a <= b")
        level = boxes.groupBy(F.floor(F.col("block") / width).alias("at")).agg(*[(F.min if s[:2] == "lo" else F.max)(s).alias(s) for s in sides])
        left = level.select(F.col("at").alias("a_at"), *[F.col(s).alias(f"a_{s}") for s in sides])
        right = level.select(F.col("at").alias("b_at"), *[F.col(s).alias(f"b_{s}") for s in sides])
        gaps = [F.greatest(F.lit(0.0), F.col(f"a_lo_{c}") - F.col(f"b_hi_{c}"), F.col(f"b_lo_{c}") - F.col(f"a_hi_{c}")) for c in _corners()]
        pairs = pairs.join(left, pairs["a"] == F.col("a_at")).join(right, pairs["b"] == F.col("b_at")).filter(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]) <= eps * eps + 1e-9).select("a", "b")
    return pairs


def _near_chunks(lo: np.ndarray, hi: np.ndarray, a: tuple[int, int], b: tuple[int, int], far: float) -> list[tuple[int, int]]:
    """Pairs of chunks out of two intervals of the sequence that are not provably too far apart; the longer interval is halved first."""
    gap = np.maximum(0, np.maximum(lo[a[0] : a[1]].min(axis=0) - hi[b[0] : b[1]].max(axis=0), lo[b[0] : b[1]].min(axis=0) - hi[a[0] : a[1]].max(axis=0)))
    if (gap * gap).sum() > far:
        return []
    wide_a, wide_b = a[1] - a[0], b[1] - b[0]
    if wide_a == wide_b == 1:
        return [(a[0], b[0])]
    if wide_a >= wide_b:
        mid = (a[0] + a[1]) // 2
        if a == b:  # both halves against themselves, and one against the other
            low, high = (a[0], mid), (mid, a[1])
            return _near_chunks(lo, hi, low, low, far) + _near_chunks(lo, hi, low, high, far) + _near_chunks(lo, hi, high, high, far)
        return _near_chunks(lo, hi, (a[0], mid), b, far) + _near_chunks(lo, hi, (mid, a[1]), b, far)
    mid = (b[0] + b[1]) // 2
    return _near_chunks(lo, hi, a, (b[0], mid), far) + _near_chunks(lo, hi, a, (mid, b[1]), far)


def linked(x: np.ndarray, rows: np.ndarray, others: np.ndarray, similarity: float, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i in rows, j in others) with cosine `similarity` or more. x: unit vectors; single: the same in single precision."""
    rough = single[rows] @ single[others].T
    doubt = 1e-6 + 3e-7 * x.shape[1]
    i, j = np.nonzero(rough >= similarity - doubt)
    unsure = np.flatnonzero(rough[i, j] < similarity + doubt)
    miss = unsure[(x[rows[i[unsure]]] * x[others[j[unsure]]]).sum(axis=1) < similarity]
    return np.delete(i, miss), np.delete(j, miss)


def _roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Least place that each of n places is joined with by the edges (i, j)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            return label


def compare(t: pa.Table, similarity: float, far: float) -> pa.Table:
    """Chunks of one block or of two -> a, b, n: a forest (a, b) of their links, and (a, null, n): vectors linked with a, copies counted."""
    block = t["block"].to_numpy()
    order = np.lexsort((t["chunk"].to_numpy(), block))
    t, block = t.take(pa.array(order)), block[order]
    members = t["members"].combine_chunks()
    of_chunk = np.repeat(np.arange(t.num_rows), members.value_lengths().to_numpy())
    inner = members.flatten()
    node, copies = inner.field("node").to_numpy(), inner.field("copies").to_numpy()
    flat, starts = _vectors(inner.field("v"))
    lo, hi = (np.array(t[c].to_pylist(), float) for c in ("lo", "hi"))
    half = int(np.searchsorted(block, block[0], side="right"))
    two = half < len(block)
    pairs = _near_chunks(lo, hi, (0, half), (half, len(block)) if two else (0, half), far)
    meets: dict[int, list[int]] = {}
    for a, b in pairs:
        meets.setdefault(a, []).append(b)
    total, left, right = np.zeros(len(node), np.int64), [], []
    for length, rows in _same_lengths(starts):
        x = unit(flat[starts[rows][:, None] + np.arange(length)])
        single, chunk = x.astype(np.float32), of_chunk[rows]
        for a, bs in meets.items():
            mine, theirs = np.flatnonzero(chunk == a), np.flatnonzero(np.isin(chunk, bs))
            if not len(mine) or not len(theirs):
                continue
            i, j = linked(x, mine, theirs, similarity, single)
            i, j = mine[i], theirs[j]
            once = (chunk[i] != chunk[j]) | (i < j)
            i, j = i[once], j[once]
            if not len(i):
                continue
            total[rows] += np.bincount(i, copies[rows[j]], len(rows)).astype(np.int64) + np.bincount(j, copies[rows[i]], len(rows)).astype(np.int64)
            label = _roots(i, j, len(rows))
            joined = np.flatnonzero(label != np.arange(len(rows)))
            left.append(rows[label[joined]])
            right.append(rows[joined])
    some = np.flatnonzero(total)
    a, b = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (left, right))
    label = _roots(a, b, len(node))
    joined = np.flatnonzero(label != np.arange(len(node)))
    return pa.table({
        "a": pa.array(np.concatenate([node[some], node[label[joined]]])),
        "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[joined])]),
        "n": pa.concat_arrays([pa.array(total[some]), pa.nulls(len(joined), pa.int64())])})


def vector_links(vectors: DataFrame, similarity: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of `vectors`.

    n_links counts the other rows of cosine `similarity` or more (in double precision), equal vectors included; component_id is the
    least id reachable by links, the row itself included. Vectors null, empty, zero or with null or non-finite components
    link with nothing, and vectors of different lengths never do. Repeated ids are rows of their own. A row without an id
    has its component's id, null if no member has one; kept compares null with null as equal. An empty table gives no rows."""
    d = named(vectors, vec_id=vec_id, v=vector).withColumn("v", F.col("v").cast("array<double>"))
    rows = store(d.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable(F.col("v")), F.col("v")).alias("v")))
    each = store(rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")))
    common = each.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    ids = F.col("vec_id")
    alone = rows.filter("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), ids.alias("component_id"), F.lit(True).alias("kept"))
    if common is None:
        return alone
    eps = float(np.sqrt(2 - 2 * similarity))
    size = max(1, min(CHUNK, CHUNK_NUMBERS // max(1, common["length"])))
    ordered = placed(each, principal_axes(each, common["length"]))
    cells = [F.floor(F.col(f"p{k}") / eps) for k in range(AXES)]
    ordered = store(numbered(ordered, "node", F.col("length"), *cells, *[F.col(f"p{k}") for k in range(AXES + 1)], F.xxhash64("v"), F.col("v")))
    count = -(-ordered.count() // (size * BLOCK))
    corners = _corners()
    chunks = store(
        ordered.groupBy(F.floor(F.col("node") / (size * BLOCK)).alias("block"), F.floor(F.col("node") / size).alias("chunk"))
        .agg(F.collect_list(F.struct("node", "copies", "v")).alias("members"),  # at most `size` of them
             F.array(*[F.min(c).cast("double") for c in corners]).alias("lo"), F.array(*[F.max(c).cast("double") for c in corners]).alias("hi")))
    sides = [(F.min if end == "lo" else F.max)(F.col(end)[k]).alias(f"{end}_{c}") for k, c in enumerate(corners) for end in ("lo", "hi")]
    boxes = store(chunks.groupBy("block").agg(*sides))
    pairs = near_intervals(boxes, count, eps)
    asked = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("of"))
    tiles = asked.join(chunks, asked["of"] == chunks["block"]).select("a", "b", "block", "chunk", "members", "lo", "hi")
    far = eps * eps + 1e-9
    found = store(tiles.groupBy("a", "b").applyInArrow(lambda t: compare(t.drop_columns(["a", "b"]), similarity, far), "a long, b long, n long"))
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("of")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("at"), "root")
    node = ordered.select("node", "least", "copies", F.col("v").alias("same")).join(links, F.col("node") == F.col("of"), "left").join(roots, F.col("node") == F.col("at"), "left")
    node = store(node.select("same", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root")))
    top = store(node.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id")))  # stored, so that the joins can split hot groups
    node = store(node.join(top, node["root"] == top["of"]).select("same", "n_links", "component_id"))
    return rows.join(node, rows["v"] == node["same"]).select("vec_id", "n_links", "component_id", ids.eqNullSafe(F.col("component_id")).alias("kept")).union(alone)
