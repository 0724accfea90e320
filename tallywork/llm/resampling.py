"""Importance resampling of documents towards a target: scores from arrays of bucket gains, a cutoff by bisection.

Features (runs of words) are hashed into buckets. The log ratio of a bucket's share in the target and in the documents is
its gain; a document weighs the sum over its features. With Gumbel noise from a hash of the id added, the highest scores are
a sample without replacement. The cutoff is found by exact counts over the stored scores, a few probes a job, among equal
scores by id; only what is drawn is sorted, by ranges.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import named, numbered

#: Buckets of features.
BUCKETS = 10_000
#: Probes of one count job of the bisection.
PROBES = 31
#: Features whose bucket a task remembers at a time.
REMEMBERED = 500_000

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all code points beyond ASCII, A-Z in lower case, as UTF-8; null has none."""
    return _WORDS((text or "").encode("utf-8", "surrogatepass").lower())


class Features(dict):
    """Bucket of a feature by its checksum; forgets all when it has grown too large."""

    def __missing__(self, feature: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % BUCKETS
        return bucket

    def of(self, words: list[bytes], longest: int) -> np.ndarray:
        """The buckets of all runs of 1 to `longest` words, repeats included."""
        found = [self[w] for w in words]
        for n in range(2, longest + 1):
            found += [self[b" ".join(words[k : k + n])] for k in range(len(words) - n + 1)]
        return np.array(found, np.int64)


def bucket_counts(rows: DataFrame, longest: int = 1, text: str = "text") -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket that any does. Tasks add up before the shuffle."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in batch["text"]:
                total += np.bincount(features.of(words_of(t.as_py()), longest), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return named(rows, text=text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """Per bucket floor(1000 ln of its smoothed share in `target` over that in `source`), from two tables (bucket, n) of at most BUCKETS rows."""
    s, t = [0] * BUCKETS, [0] * BUCKETS
    for into, rows in ((s, source), (t, target)):
        for r in rows.collect():
            into[r["bucket"]] = r["n"]
    all_s, all_t = float(sum(s) + BUCKETS), float(sum(t) + BUCKETS)
    return np.array([math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s, t)], np.int64)


def noise(seed: int, doc_id: str) -> int:
    """Gumbel noise of a document in thousandths, from the first 32 bits of a digest of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, longest: int = 1, seed: int = 2024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row. A null text has no words and weight 0; a null id is hashed as an empty one."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            words, number, weight = [], [], []
            for t in batch["text"]:
                w = words_of(t.as_py())
                found = features.of(w, longest)
                words.append(len(w))
                number.append(len(found))
                weight.append(int(gain[found].sum()))
            score = [w + noise(seed, i) for w, i in zip(weight, batch["hashed"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, pa.int64()) for x in (words, number, weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    d = named(docs, doc_id=doc_id, text=text)
    kind = d.schema["doc_id"].dataType.simpleString()
    d = d.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("hashed"), "text")
    return d.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def cutoff(rows: DataFrame, value: Column, drawn: int) -> tuple[int, int]:
    """(v, above): the greatest whole number v that `drawn` or more rows reach, and how many rows lie above it.

    Each job counts the rows at or over PROBES numbers; the interval shrinks by as much, whatever the table's size."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    reach = None
    while low < high:
        width = high - low
        probes = sorted({low + max(1, width * k // (PROBES + 1)) for k in range(1, PROBES + 1)} | {high})
        counted = rows.agg(*[F.count(F.when(value >= p, 1)) for p in probes]).first()
        over = [k for k, n in enumerate(counted) if n >= drawn]
        if over:
            low = probes[over[-1]]
        if len(over) < len(probes):
            high, reach = probes[len(over)] - 1, counted[len(over)]
            if high < low:
                high = low
    return low, rows.filter(value > low).count() if reach is None or low < high else reach


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, seed: int = 2024, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank: `percent` of the documents of `least_words` words or more are drawn and ranked.

    The highest scores are drawn, ties to the smaller doc_id, then (repeated ids) by a fixed order of the stored rows; a row
    without an id comes after those with one. Rank is null for the rest. Empty tables are fine: without documents there are no rows, without a
    target every bucket has a gain all the same."""
    gain = gains(bucket_counts(docs, longest, text), bucket_counts(target, longest, target_text))
    rows = store(scores(docs, gain, longest, seed, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    able = rows.filter(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    # Whatever is smaller first gets its bits turned, so that greater is first throughout.
    order = [F.col("score"), F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(-(1 << 63))), F.bitwise_not("row")]
    left, tied, chosen = drawn, able, F.lit(False)
    if drawn:
        equal = F.lit(True)
        for value in order:
            edge, above = cutoff(tied, value, left)
            chosen = chosen | (equal & (value > edge))
            equal, tied, left = equal & (value == edge), tied.filter(value == edge), left - above
        chosen = chosen | equal
    out = [*(F.col(c) for c in ("doc_id", "n_features", "weight", "score"))]
    picked = (F.col("n_words") >= least_words) & chosen
    ranked = numbered(rows.filter(picked), "place", F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    rest = rows.filter(~picked).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*out, (F.col("place") + 1).cast("long").alias("rank")).union(rest)
