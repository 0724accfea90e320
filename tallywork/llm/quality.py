"""Quality of whole texts: statistics of the text, scored by histogram gradient-boosted trees."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import held_out, labelled_sample, named

#: Labelled rows that a fit sees at most.
FIT_ROWS = 20_000
_KIND = np.zeros(256, np.int64)  # of a byte: letter 0, upper 1, digit 2, space 3, end mark 4, comma 5, bar 6, sign 7, bracket or quote 8, part of a longer character 9
for _kind, _chars in ((1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, b"0123456789"), (3, b" \t\n\r\x0b\x0c"), (4, b".!?"), (5, b",;:"), (6, b"|"), (7, b"#$%&*@^~_=+<>\\/`"), (8, b"()[]{}\"'-")):
    _KIND[list(_chars)] = _kind
_KIND[128:] = 9


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text. A null or empty text has them too, mostly zeros."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=10) / max(1, len(raw))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    count = Counter(words)
    top = count.most_common(3)
    line_words = np.array([line.count(" ") + 1 for line in lines])
    same = sum(map(str.__eq__, words, words[1:]))
    full = [line for line in lines if line]
    return [
        *kinds, np.log1p(len(text)), np.log1p(len(words)), float(lengths.mean()), float(lengths.std()), float(lengths.max()),
        len(count) / n, top[0][1] / n if top else 0.0, sum(c for _, c in top) / n, same / n, float((lengths <= 3).mean()), float((lengths >= 9).mean()),
        np.log1p(len(lines)), float(np.log1p(line_words).mean()), float((line_words <= 2).mean()), len(set(full)) / max(1, len(full)),
        sum(line[-1] in ".!?" for line in full) / max(1, len(full)), text.count(". ") / n, float(np.abs(np.diff(lengths)).mean()) if len(words) > 1 else 0.0,
    ]


def _described(df: DataFrame, out: str, keep: str) -> DataFrame:
    """`keep` and the statistics as one array."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({keep: pdf[keep], out: [statistics(t) for t in pdf["text"]]})

    return df.select(keep, "text").mapInPandas(run, f"{keep} {df.schema[keep].dataType.simpleString()}, {out} array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> boosting.Forest:
    """A forest learnt from at most `rows` labelled documents whose labels may be learnt from."""
    seen = _described(labelled_sample(docs, labels, label, rows), "x", "y").toPandas()
    width = len(statistics(""))
    x = np.stack(seen["x"].to_numpy()) if len(seen) else np.zeros((0, width))
    order = np.lexsort((*x.T, seen["y"].to_numpy())) if len(seen) else []
    return boosting.fit(x[order], seen["y"].to_numpy(float)[order])


def score(docs: DataFrame, forest: boosting.Forest, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts are scored by their statistics like any other."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([statistics(t) for t in pdf["text"]]) if len(pdf) else np.zeros((0, len(statistics(""))))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": forest.score(x)})

    d = named(docs, doc_id=doc_id, text=text)
    kind = d.schema["doc_id"].dataType.simpleString()
    made = d.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, score double")
    made = made.withColumn("doc_id", F.col("doc_id").cast(kind))
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
