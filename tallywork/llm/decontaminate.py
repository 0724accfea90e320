"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows of words. Those of one length are searched together: a shift table over blocks of
two words says how far the next possible occurrence is, so most positions of a document are skipped; where the shift is
zero, the pattern's suffix block leads to the few candidates, which are compared word by word.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import named

#: The words of both tables, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Window patterns one pass over the documents searches. A benchmark with more takes several passes.
PATTERNS_A_PASS = 400_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def windows(items: DataFrame, window: int = 13, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, words: each item's windows of `window` consecutive words, once; a shorter item, but not an empty one, is one window."""
    d = named(items, item_id=item_id, text=text).select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    each = d.filter(F.size("w") > 0).select("item_id", "w", F.explode(starts).alias("at"))
    return each.select("item_id", F.slice("w", F.col("at"), window).alias("words")).distinct()


class WuManber:
    """Occurrences of patterns of one length of at least 1 in sequences of word numbers."""

    def __init__(self, patterns: dict[tuple[int, ...], int]):
        self.patterns = patterns
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.far = self.length - self.block + 1
        self.shift: dict[tuple[int, ...], int] = {}
        self.suffix: dict[tuple[int, ...], list[tuple[int, ...]]] = defaultdict(list)
        for p in patterns:
            for end in range(self.block, self.length + 1):
                block = p[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.far), self.length - end)
            self.suffix[p[-self.block :]].append(p)

    def find(self, text: list[int]) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of every occurrence, starts ascending. Word number 0 is in no pattern."""
        length, block, shift, far = self.length, self.block, self.shift, self.far
        end, n = length, len(text)
        while end <= n:
            last = tuple(text[end - block : end])
            step = shift.get(last, far)
            if step:
                end += step
                continue
            seen = tuple(text[end - length : end])
            for p in self.suffix[last]:
                if p == seen:
                    yield end - length, self.patterns[p]
            end += 1


class Searcher:
    """All matchers of one pass, one for each length of pattern, and the words they know."""

    def __init__(self, patterns: list[tuple[list[str], list[str]]]):
        self.number: dict[str, int] = {}
        by_length: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
        self.items = [items for _, items in patterns]
        for k, (words, _) in enumerate(patterns):
            by_length[len(words)][tuple(self.number.setdefault(w, len(self.number) + 1) for w in words)] = k
        self.matchers = [WuManber(p) for p in by_length.values()]
        self.split = re.compile(WORD).findall
        self.lower = str.maketrans(UPPER, LOWER)

    def search(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged spans of hit words, items found."""
        words = self.split((text or "").translate(self.lower))
        get = self.number.get
        numbers = [get(w, 0) for w in words]
        found = [(s, s + m.length, k) for m in self.matchers for s, k in m.find(numbers)]
        spans: list[tuple[int, int]] = []
        for start, end, _ in sorted(found):
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], end))
            else:
                spans.append((start, end))
        return len(words), spans, {i for _, _, k in found for i in self.items[k]}


def occurrences(docs: DataFrame, items: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, spans (array of [start, end) word positions in a benchmark window), items (ids found, sorted as text).

    One row per row of `docs`, repeats too. Null and empty texts have no words and no hits; an empty benchmark hits
    nothing; an id that several items share counts once. The patterns of a pass have a fixed bound and go along
    with the task's code; a larger benchmark is searched in several passes whose hits are then united."""
    pattern = windows(items, window).groupBy("words").agg(F.collect_set("item_id").alias("items"))
    pattern = store(pattern)
    passes = max(1, -(-pattern.count() // PATTERNS_A_PASS))
    d = named(docs, doc_id=doc_id, text=text)
    kind = d.schema["doc_id"].dataType.simpleString()
    d = d.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    if passes == 1:
        found = _one_pass(d, pattern.collect())
    else:
        d = store(d.withColumn("row", F.monotonically_increasing_id()))
        parts = [_one_pass(d, pattern.filter(F.pmod(F.xxhash64("words"), F.lit(passes)) == k).collect()) for k in range(passes)]
        every = parts[0]
        for part in parts[1:]:
            every = every.union(part)
        united = every.groupBy("row").agg(
            F.first("doc_id", ignorenulls=True).alias("doc_id"), F.first("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        found = united.select("doc_id", "n_words", _merged(F.col("spans")).alias("spans"), "items")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def _merged(spans: Column) -> Column:
    """Sorted spans with those that meet joined."""
    empty = F.array().cast("array<array<int>>")

    def join(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        meets = (F.size(done) > 0) & (span[0] <= last[1])
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(last[0], F.greatest(last[1], span[1]))))
        return F.when(meets, joined).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, empty, join)


def _one_pass(docs: DataFrame, patterns: list) -> DataFrame:
    known = [(list(p["words"]), list(p["items"])) for p in patterns]
    extra = "row" in docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searcher = Searcher(known)
        for pdf in batches:
            rows = [searcher.search(t) for t in pdf["text"]]
            out = {
                "doc_id": pdf["doc_id"], "n_words": [r[0] for r in rows], "spans": [[list(s) for s in r[1]] for r in rows],
                "items": [sorted(r[2]) for r in rows],
            }
            yield pd.DataFrame(out | ({"row": pdf["row"]} if extra else {}))

    return docs.mapInPandas(run, "doc_id string, n_words long, spans array<array<int>>, items array<string>" + ", row long" * extra)


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, spans, contaminated (a hit, and at least a twentieth of the words hit)."""
    found = occurrences(docs, items, window, doc_id, text)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    found = found.withColumn("n_hit", hit)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """The rows of `docs` that are not contaminated, whole; a row without an id is judged by its text like any other.

    Rows are told apart by id and text, so equal rows share one verdict."""
    key = F.xxhash64(docs["doc_id"].cast("string"), docs["text"])
    bad = contamination(docs.select(key.alias("row_key"), docs["text"]), items, window, doc_id="row_key").filter("contaminated")
    bad = bad.select(F.col("doc_id").alias("bad_key")).distinct()
    return docs.join(bad, key == bad["bad_key"], "left_anti")
