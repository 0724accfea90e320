"""Near duplicates by SimHash and covering locality-sensitive hashing.

A fingerprint has 64 bits a word. Structured masks choose about half of the bits of a field; they are built so that two
fields which differ in at most `radius` bits agree on all bits of at least one mask, whatever those bits are. A pair
within the radius therefore always meets in the bucket of that mask: nothing is left to chance.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import named, whole_runs
from .components import components

#: Rows of a bucket that one task compares; larger buckets are cut into blocks and every two blocks meet in a task.
BUCKET_ROWS = 8192
#: The same for shingle sets, of which exact Jaccard is taken.
BLOCK_SETS = 1024
#: Lanes of the fingerprints that bring near duplicates together, and the bits that one of a lane's two fields may differ in.
LANES, FIELD_REACH = 5, 4
MIX = (0x0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """Big-endian XXH64 of every shingle of the A-Z lower-cased words, repeats included, as an (n, 8) byte matrix."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(w)
    ends = list(accumulate((len(x) + 1 for x in w)))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_digest
    made = [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :] or ends[-1:])]
    return np.frombuffer(b"".join(made), np.uint8).reshape(-1, 8)


def simhash(text: str | None, words: int, seed: int = 42, lanes: int = 1, repeats: bool = True) -> bytes:
    """`lanes` 64-bit fingerprints, most significant bit first; a text without words gives zeros.

    The first lane is set where over half of the hashes are; further lanes do the same with the hashes mixed anew.
    Without `repeats` each different shingle counts once."""
    h = shingle_hashes(text, words, seed)
    return _majority(h if repeats else _distinct(h), lanes)


def _distinct(h: np.ndarray) -> np.ndarray:
    return np.unique(h.view(">u8")).view(np.uint8).reshape(-1, 8)


def _majority(h: np.ndarray, lanes: int) -> bytes:
    if not len(h):
        return bytes(8 * lanes)
    if lanes > 1:
        base = h.view(">u8").astype(np.uint64)
        h = np.concatenate([h, *[_mixed(base, MIX[k % 4] + 2 * (k // 4)).astype(">u8").view(np.uint8) for k in range(1, lanes)]], axis=1)
    count = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(h), 4096):  # a very long text never needs all its bits at once
        count += np.unpackbits(h[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > len(h)).tobytes()


def _mixed(h: np.ndarray, step: int) -> np.ndarray:
    z = h + np.uint64(step)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, lanes: int = 1, repeats: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, f0 .. f(lanes-1) (long, the bits as they are). One row per row of `docs`; a null text has no words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = b"".join(simhash(t, words, seed, lanes, repeats) for t in pdf["text"])
            cols = np.frombuffer(made, ">i8").reshape(-1, lanes).astype(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **{f"f{k}": cols[:, k] for k in range(lanes)}})

    d = named(docs, doc_id=doc_id, text=text)
    kind = d.schema["doc_id"].dataType.simpleString()
    # The id travels as text: a long column with nulls would pass through pandas as doubles.
    out = d.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, " + ", ".join(f"f{k} long" for k in range(lanes)))
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def covering_masks(radius: int, bits: int, low: int = 0) -> list[int]:
    """2^(radius+1) - 1 masks over bits low .. low+bits-1: any `radius` of these bits are all left out by some mask.

    Bit i gets a nonzero vector m(i) of radius+1 binary digits, in turn. The mask of v holds the bits with odd <m(i), v>.
    The vectors of `radius` bits span less than the whole space, so some nonzero v is orthogonal to them all."""
    size = (1 << (radius + 1)) - 1
    vector = [i % size + 1 for i in range(bits)]
    return [sum(1 << (low + i) for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_keys(lanes: list[str], masks: list[int]) -> Column:
    """One key for each lane and mask."""
    return F.array(*[F.xxhash64(F.lit(1000 * k + i), F.col(lane).bitwiseAND(F.lit(_signed(m)))) for k, lane in enumerate(lanes) for i, m in enumerate(masks)])


def split_buckets(rows: DataFrame, most: int = BUCKET_ROWS) -> DataFrame:
    """rows(bucket, ...) in which no bucket exceeds about 2 x `most` rows and every two rows of a bucket still meet.

    A larger bucket is cut into blocks by a hash of the row; a row goes to the bucket of each pair of blocks that holds its own."""
    hot = store(rows.groupBy(F.col("bucket").alias("hot")).count().filter(F.col("count") > most))
    if hot.isEmpty():
        return rows
    kept = rows.join(hot, rows["bucket"] == hot["hot"], "left_anti")
    blocks = F.ceil(F.col("count") / most).cast("int")
    big = rows.join(hot, rows["bucket"] == hot["hot"]).withColumn("blocks", blocks)
    big = big.withColumn("own", F.pmod(F.xxhash64(*rows.columns[1:]), F.col("blocks")).cast("int"))
    big = big.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    return kept.union(big.select(pair.alias("bucket"), *rows.columns[1:]))


def link_buckets(rows: DataFrame, lanes: list[str], radius: int, node: str) -> DataFrame:
    """rows(bucket, node, lanes) -> edges(a, b): a spanning forest of each bucket's pairs within `radius` bits over all lanes."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "bucket", 200_000):
            bucket, ids = t["bucket"].to_numpy(), t[node].to_numpy()
            a, b = forest(bucket, np.stack([t[x].to_numpy().view(np.uint64) for x in lanes], axis=1), radius)
            if len(a):
                pairs = np.unique(np.stack([ids[a], ids[b]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    # In the order of the nodes the root of a bucket's forest is its least node, so buckets of one group give much the same edges.
    spread = split_buckets(rows).repartition("bucket").sortWithinPartitions("bucket", node)
    return spread.mapInArrow(run, "a long, b long").distinct()


def near_rows(rows: DataFrame, lane: str, radius: int) -> DataFrame:
    """rows(bucket, lane) -> distinct lane values that have another within `radius` bits in one of their buckets."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "bucket", 200_000):
            bits = t[lane].to_numpy()
            a, b = forest(t["bucket"].to_numpy(), bits.view(np.uint64)[:, None], radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(bits[np.concatenate([a, b])]))], names=["near"])

    spread = split_buckets(rows).repartition("bucket").sortWithinPartitions("bucket")
    return spread.mapInArrow(run, "near long").distinct()


def forest(bucket: np.ndarray, bits: np.ndarray, radius: int, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """(root, row) indexes that connect the rows of each run of equal buckets as all their pairs within the radius would."""
    n = len(bucket)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))
    size_of = np.repeat(sizes, sizes)
    place = np.arange(n) - np.repeat(starts, sizes)
    left, right = [], []
    row = np.flatnonzero((size_of > 1) & (size_of <= small))
    for step in range(1, small):
        row = row[place[row] + step < size_of[row]]
        if not len(row):
            break
        hit = row[_apart(bits[row], bits[row + step]) <= radius]
        left.append(hit)
        right.append(hit + step)
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    label = np.arange(n)
    while len(i):  # the least row reachable; runs are short here
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            break
    for s, k in zip(starts[sizes > small], sizes[sizes > small]):
        label[s : s + k] = s + _walk(bits[s : s + k], radius)
    rows = np.flatnonzero(label != np.arange(n))
    return label[rows], rows


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _walk(bits: np.ndarray, radius: int) -> np.ndarray:
    """Component label of each row. A row found once is never compared again, so a dense group costs few passes."""
    label = np.arange(len(bits))
    open_rows = np.arange(len(bits))
    while len(open_rows):
        root, edge = open_rows[0], open_rows[:1]
        open_rows = open_rows[1:]
        while len(edge) and len(open_rows):
            take = max(1, 2_000_000 // (len(open_rows) * bits.shape[1]))
            now, edge = edge[:take], edge[take:]
            near = (_apart(bits[now][:, None, :], bits[open_rows][None, :, :]) <= radius).any(axis=0)
            found, open_rows = open_rows[near], open_rows[~near]
            label[found] = root
            edge = np.concatenate([edge, found])
    return label


def fingerprint_components(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest id reachable over fingerprints `radius` or fewer bits apart.

    Texts null, empty or of white space have fingerprint zero and are linked like any other; repeated rows share their
    component; a row without id gets its component's id (null if no member has one). An empty table gives no rows."""
    prints = store(fingerprints(docs, words, seed, 1, True, doc_id, text))
    each = store(prints.groupBy("f0").agg(F.min("doc_id").alias("least")))
    rows = each.select(F.explode(bucket_keys(["f0"], covering_masks(radius, 64))).alias("bucket"), F.col("f0"))
    found = components(link_buckets(rows, ["f0"], radius, "f0"))
    member = each.join(found, each["f0"] == found["node"], "left").select("f0", "least", F.coalesce("root", "f0").alias("root"))
    top = store(member.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id")))  # stored, so that the join can split a large group
    ids = member.join(top, member["root"] == top["of"]).select(F.col("f0").alias("k"), "component_id")
    return prints.join(ids, prints["f0"] == ids["k"]).select(
        "doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id"
    )


def sketches(docs: DataFrame, words: int, lanes: int, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), node (hash of the set of shingles), f0 .. f(lanes-1). One row per row of `docs`."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            nodes, made = [], []
            for t in pdf["text"]:
                h = _distinct(shingle_hashes(t, words, seed))
                nodes.append(xxhash.xxh64_intdigest(h.tobytes()) - (1 << 63))
                made.append(_majority(h, lanes))
            cols = np.frombuffer(b"".join(made), ">i8").reshape(-1, lanes).astype(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "th": pdf["th"], "node": np.array(nodes, np.int64), **{f"f{k}": cols[:, k] for k in range(lanes)}})

    d = named(docs, doc_id=doc_id, text=text)
    kind = d.schema["doc_id"].dataType.simpleString()
    d = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    out = d.mapInPandas(run, "doc_id string, th long, node long, " + ", ".join(f"f{k} long" for k in range(lanes)))
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def alike(values: np.ndarray, starts: np.ndarray, similarity: float) -> np.ndarray:
    """Component label of each set values[starts[k] : starts[k + 1]], none empty, over all pairs with that Jaccard or more."""
    n = len(starts) - 1
    codes = np.unique(values, return_inverse=True)[1]
    sizes = np.diff(starts)
    label, waiting = np.arange(n), np.ones(n, bool)
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, np.int64)
    for root in range(n):
        if not waiting[root]:
            continue
        waiting[root] = False
        edge = [root]
        while edge and waiting.any():
            k = edge.pop()
            own = codes[starts[k] : starts[k + 1]]
            mark[own] = 1
            both = np.add.reduceat(mark[codes], starts[:-1])
            mark[own] = 0
            found = np.flatnonzero(waiting & (both >= similarity * (sizes + sizes[k] - both) - 1e-9))
            label[found], waiting[found] = root, False
            edge.extend(found.tolist())
    return label


def exact_links(docs: DataFrame, nodes: DataFrame, similarity: float, words: int, seed: int = 42, text: str = "text") -> DataFrame:
    """nodes(node, th, root) -> edges(a, b): a spanning forest of the pairs of one root whose shingle sets are `similarity` or more alike.

    Sets are read from the text of hash `th`. A root of many nodes is cut into blocks, of which every two meet in a task."""
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [_distinct(shingle_hashes(t, words, seed)).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"bucket": pdf["root"], "node": pdf["node"], "shingles": made})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "bucket", 4 * BLOCK_SETS):
            bucket, ids = t["bucket"].to_numpy(), t["node"].to_numpy()
            parts = [np.frombuffer(x.as_py(), ">u8").astype(np.uint64) for x in t["shingles"]]
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            for first, last in zip(edges[:-1], edges[1:]):
                rows = np.array([k for k in range(first, last) if len(parts[k])], np.int64)
                if len(rows) < 2:
                    continue
                label = alike(np.concatenate([parts[k] for k in rows]), np.concatenate([[0], np.cumsum([len(parts[k]) for k in rows])]), similarity)
                far = np.flatnonzero(label != np.arange(len(rows)))
                if len(far):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[rows[label[far]]]), pa.array(ids[rows[far]])], names=["a", "b"])

    texts = docs.select(F.xxhash64(docs[text]).alias("of"), docs[text].alias("text"))
    found = texts.join(nodes, texts["of"] == nodes["th"]).dropDuplicates(["node"]).select("root", "node", "text")
    rows = store(found.mapInPandas(sets, "bucket long, node long, shingles binary"))
    spread = split_buckets(rows, BLOCK_SETS).repartition("bucket").sortWithinPartitions("bucket", "node")
    return spread.mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, similarity: float = 0.8, words: int = 5, reach: int = 12, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, th, node of each row; found: node, root of each node alike to another).

    Texts with one set of shingles are one node. Candidates come from fingerprints of five lanes: sets of equal size with
    Jaccard J have cosine 2J/(1+J), and a bit differs with probability acos(cosine)/pi. They differ in at most `reach` bits
    of some lane and in at most 4 of one of its two 32-bit fields, which 31 masks cover, and in all lanes by no more than
    three deviations over the mean of a pair at the threshold: over 99 % of such pairs. What counts is the exact Jaccard
    of every two nodes that candidates join."""
    lanes = [f"f{k}" for k in range(LANES)]
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    apart = int(64 * LANES * share + 3 * np.sqrt(64 * LANES * share * (1 - share)))
    prints = store(sketches(docs, words, LANES, 42, doc_id, text))
    each = store(prints.groupBy("node").agg(F.min("th").alias("th"), *[F.first(x).alias(x) for x in lanes]))
    masks = covering_masks(FIELD_REACH, 32) + covering_masks(FIELD_REACH, 32, 32)
    near = []
    for lane in lanes:
        rows = each.select(F.col(lane).alias("lane")).distinct().select(F.explode(bucket_keys(["lane"], masks)).alias("bucket"), "lane")
        near.append(store(near_rows(rows, "lane", reach)))
    some = None
    for lane, found in zip(lanes, near):
        part = each.join(found, each[lane] == found["near"], "left_semi").select("node", *lanes)
        # A lane's own keys only: a pair that this lane brings together has both rows here.
        part = part.withColumn("lane", F.col(lane)).select(F.explode(bucket_keys(["lane"], masks)).alias("bucket"), "node", *lanes)
        part = part.withColumn("bucket", F.xxhash64(F.lit(lane), "bucket"))
        some = part if some is None else some.union(part)
    alike_prints = each.select("node", F.xxhash64(*lanes).alias("print"))  # one print, different sets: no lane tells them apart
    same = store(alike_prints.groupBy(F.col("print").alias("of")).agg(F.min("node").alias("a"), F.count("*").alias("times")).filter("times > 1"))
    twins = alike_prints.join(same, alike_prints["print"] == same["of"]).select("a", F.col("node").alias("b"))
    joined = components(link_buckets(store(some), lanes, apart, "node").union(twins))
    nodes = joined.join(each.select(F.col("node").alias("of"), "th"), F.col("node") == F.col("of")).select("node", "th", "root")
    return prints.select("doc_id", "th", "node"), components(exact_links(docs, store(nodes), similarity, words, 42, text))


def similar_groups(docs: DataFrame, similarity: float = 0.8, words: int = 5, reach: int = 12, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, group_id: documents joined by chains of pairs whose shingle sets are `similarity` or more alike (exact Jaccard).

    Nulls, empties, repeats and empty tables behave as in fingerprint_components; group_id is the least id of the group."""
    prints, found = near_groups(docs, similarity, words, reach, doc_id, text)
    each = store(prints.groupBy("node").agg(F.min("doc_id").alias("least")))
    member = each.join(found, each["node"] == found["node"], "left").select(each["node"].alias("k"), "least", F.coalesce("root", each["node"]).alias("root"))
    top = store(member.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("group_id")))  # stored, so that the join can split a large group
    ids = store(member.join(top, member["root"] == top["of"]).select("k", "group_id"))
    return prints.join(ids, prints["node"] == ids["k"]).select("doc_id", "group_id")


def keep_one(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """One row of each group of near duplicates, whole: the one of least doc_id, then of least hash of the text.

    Rows of one doc_id are told apart by their texts, so one without an alike row always stays; of rows equal in both one
    stays. Rows without an id stay."""
    prints, found = near_groups(docs, similarity, words)
    group = prints.filter("doc_id IS NOT NULL").join(found.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    first = group.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("doc_id", "th")).alias("first"))
    mark = f"text_hash_{uuid.uuid4().hex}"  # no caller's column
    chosen = store(first.select(F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias(mark)))
    named_rows = docs.filter(F.col("doc_id").isNotNull()).withColumn(mark, F.xxhash64("text"))
    kept = named_rows.join(chosen, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return kept.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
