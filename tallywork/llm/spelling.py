"""Spelling variants: pairs of words one edit apart, found by products of letter-count matrices.

One edit changes the letter counts of a word by a squared distance of 1 (a letter more) or 2 (a letter replaced), so a
matrix product over the counts of a block of words leaves few pairs whose letters have to be compared. Words are blocked
by the counts of a few groups of letters, which add up to the word's length: an edit moves a word to its own block, to one
where a letter has changed groups, or to one of the next length with one letter more in some group. A word is at home in
one block and visits those neighbours, so every such pair meets in exactly one block.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import named, whole_runs

#: Letters are the Latin-1 code points; those alike modulo GROUPS share a group.
GROUPS = 7
#: Different words that a task counts before it passes them on.
HELD_WORDS = 200_000
#: Words of a block that one task compares; larger blocks are cut and every two pieces meet.
BLOCK_WORDS = 16_384
#: Entries of one product of count matrices.
PRODUCT = 4_000_000

_RUNS = re.compile(rb"[a-z\xc0-\xff]+").findall


def words_of(text: str | None, doc_id: str, every: int) -> list[bytes]:
    """The runs of Latin letters, A-Z in lower case, as Latin-1; one in `every` (by checksum) lacks a letter.

    Code points beyond Latin-1 part runs as any other character does."""
    if not text:
        return []
    runs = _RUNS(text.encode("latin-1", "replace").lower())
    seed = zlib.crc32(f"{doc_id}:".encode("utf-8", "surrogatepass"))
    checks = [zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), seed) for w in runs]
    for k in np.flatnonzero(np.array(checks, np.int64) % every == 0).tolist():
        at = checks[k] % len(runs[k])
        runs[k] = runs[k][:at] + runs[k][at + 1 :]
    return runs


def vocabulary(docs: DataFrame, shortest: int = 5, least: int = 3, every: int = 97, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the words of `shortest` letters or more that occur `least` times or more over all texts.

    A null text has no words, a null id is written as an empty one; repeated rows count each time; an empty table gives no rows."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for i, t in zip(batch["doc_id"].to_pylist(), batch["text"]):
                held.update(words_of(t.as_py(), i, every))
                if len(held) > HELD_WORDS:
                    yield made(held)
                    held = Counter()
        yield made(held)

    def made(held: Counter) -> pa.RecordBatch:
        kept = [(w.decode("latin-1"), n) for w, n in held.items() if len(w) >= shortest]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    d = named(docs, doc_id=doc_id, text=text).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return d.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, a row for each word, 0 after its end; lengths)."""
    sizes = np.array([len(w) for w in words])
    wide = int(sizes.max())
    return np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(-1, wide), sizes


def counts(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each word has each letter that occurs among them; doubles once a square could pass float's whole numbers."""
    rows = np.repeat(np.arange(len(codes)), sizes)
    present, column = np.unique(codes[codes > 0], return_inverse=True)
    kind = np.float32 if codes.shape[1] < 2000 else np.float64
    return np.bincount(rows * len(present) + column, minlength=len(codes) * len(present)).reshape(len(codes), -1).astype(kind)


def one_edit(short: np.ndarray, longer: np.ndarray, n: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Which pairs of letter rows (lengths n and more, more - n is 0 or 1) differ by one replaced or one inserted letter."""
    same = short == longer
    inside = np.arange(short.shape[1])[None, :] < n[:, None]
    head = np.where((~same & inside).any(axis=1), (same | ~inside).argmin(axis=1), n)  # letters alike from the front
    after = np.zeros_like(short)
    after[:, :-1] = longer[:, 1:]
    tail = ((short == after) | ~inside)[:, ::-1]  # alike from the end, shifted by one
    behind = np.where(tail.all(axis=1), short.shape[1], tail.argmin(axis=1)) - (short.shape[1] - n)
    return np.where(more == n, (~same & inside).sum(axis=1) == 1, head + behind >= n)


def near_in_block(words: list[bytes], home: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the words one edit apart, i at home, j at home (i < j) or visiting. With `own`, only across pieces."""
    codes, sizes = letters(words)
    at_home = np.flatnonzero(home)
    x = counts(codes, sizes)
    square = (x * x).sum(axis=1)
    left, right = [], []
    step = max(1, PRODUCT // len(words))
    for first in range(0, len(at_home), step):
        i = at_home[first : first + step]
        apart = square[i][:, None] + square[None, :] - 2 * (x[i] @ x.T)
        a, j = np.nonzero(apart <= 2)
        i = i[a]
        keep = (np.abs(sizes[i] - sizes[j]) <= 1) & (~home[j] | (i < j))
        if own is not None:
            keep &= own[i] != own[j]
        i, j = i[keep], j[keep]
        swap = sizes[i] > sizes[j]
        short, longer = np.where(swap, j, i), np.where(swap, i, j)
        for cut in range(0, len(i), 1 << 18):
            s, m = short[cut : cut + (1 << 18)], longer[cut : cut + (1 << 18)]
            hit = one_edit(codes[s], codes[m], sizes[s], sizes[m])
            left.append(i[cut : cut + (1 << 18)][hit])
            right.append(j[cut : cut + (1 << 18)][hit])
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def spots(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word's place, block, at home): a block is known by the weighted sum of its group counts, modulo 2^64."""
    weight = np.random.default_rng(97).integers(1, 1 << 63, GROUPS, np.uint64) * np.uint64(2) + np.uint64(1)
    rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
    group = np.frombuffer(b"".join(words), np.uint8) % GROUPS
    has = np.bincount(rows * GROUPS + group, minlength=len(words) * GROUPS).reshape(-1, GROUPS)
    key, every = (has.astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64), np.arange(len(words))
    made = [(every, key, np.ones(len(words), bool))]
    for g in range(GROUPS):
        made.append((every, key + weight[g], np.zeros(len(words), bool)))  # the next length
        some = np.flatnonzero(has[:, g])
        for other in range(g + 1, GROUPS):
            made.append((some, key[some] + weight[other] - weight[g], np.zeros(len(some), bool)))
    place, bucket, home = (np.concatenate(x) for x in zip(*made))
    return place, bucket.view(np.int64), home


def blocks(words: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """bucket, home, own, other, word, n: each word at home in its block and visiting the neighbours.

    A block of over `most` words is cut into pieces by a hash of the word and every two pieces meet: `own` is the word's
    piece, `other` the one it meets there."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place, bucket, home = spots([w.as_py().encode("latin-1") for w in batch["word"]])
            for cut in range(0, len(place), 1 << 17):
                span = slice(cut, cut + (1 << 17))
                at = pa.array(place[span])
                yield pa.RecordBatch.from_arrays([pa.array(bucket[span]), pa.array(home[span]), batch["word"].take(at), batch["n"].take(at)], names=["bucket", "home", "word", "n"])

    rows = words.select("word", "n").mapInArrow(run, "bucket long, home boolean, word string, n long")
    hot = store(rows.groupBy(F.col("bucket").alias("hot")).agg(F.count("*").alias("rows"), F.bool_or("home").alias("used")).filter(F.col("used") & (F.col("rows") > most)))
    whole = rows.withColumns({"own": F.lit(0), "other": F.lit(0)})
    if hot.isEmpty():
        return whole
    pieces = F.ceil(F.col("rows") / most).cast("int")
    cut = rows.join(hot, rows["bucket"] == hot["hot"]).withColumn("own", F.pmod(F.xxhash64("word"), pieces).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1)))
    meeting = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    return whole.join(hot, whole["bucket"] == hot["hot"], "left_anti").union(cut.select(meeting.alias("bucket"), "home", "word", "n", "own", "other"))


def near_words(words: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """words(word, n), each word once -> word, near, near_n: every two words one edit apart, both ways."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "bucket", 100_000):
            bucket, home, n = (t[c].to_numpy(zero_copy_only=False) for c in ("bucket", "home", "n"))
            word = t["word"].combine_chunks()
            own, other = t["own"].to_numpy(), t["other"].to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            first, second = [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if b - a < 2 or not home[a:b].any():
                    continue
                across = own[a:b] if (own[a:b] != other[a:b]).any() else None
                i, j = near_in_block([w.encode("latin-1") for w in word[a:b].to_pylist()], home[a:b], across)
                first.append(i + a)
                second.append(j + a)
            if first:
                i, j = np.concatenate(first), np.concatenate(second)
                x, y = np.concatenate([i, j]), np.concatenate([j, i])
                yield pa.RecordBatch.from_arrays([word.take(pa.array(x)), word.take(pa.array(y)), pa.array(n[y])], names=["word", "near", "near_n"])

    dealt = blocks(words, most).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "word string, near string, near_n long")


def variants(words: DataFrame, times: int = 2, most: int = BLOCK_WORDS) -> DataFrame:
    """words(word, n) -> word, form, root, n, n_near, form_n.

    form: the near word of largest n (ties: smallest in code-point order) if it is `times` the word's n or more, else null.
    root: the last form that following forms leads to, the word itself without one. An empty table gives no rows."""
    words = store(words)
    best = near_words(words, most).groupBy(F.col("word").alias("of")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    has = F.coalesce(-F.col("best.less") >= times * F.col("n"), F.lit(False))
    each = store(words.join(best, words["word"] == best["of"], "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("best.form")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")))
    # Each round doubles the steps followed; counts grow along a chain, so it is short and has an end.
    step = store(each.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = step.select(F.col("word").alias("at"), F.col("root").alias("beyond"))
        if step.join(ahead, step["root"] == ahead["at"], "left_semi").isEmpty():
            break
        step = store(step.join(ahead, step["root"] == ahead["at"], "left").select("word", F.coalesce("beyond", "root").alias("root")))
    last = step.select(F.col("word").alias("of"), "root")
    return each.join(last, each["word"] == last["of"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
