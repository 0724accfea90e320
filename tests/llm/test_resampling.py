"""Importance resampling against a plain computation."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from tallywork.llm import resampling


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, longest):
    w = words(text)
    return [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10000 for n in range(1, longest + 1) for k in range(len(w) - n + 1)]


def brute(docs, target, percent=10, least=20, longest=1):
    s, t = (Counter(b for x in texts for b in features(x, longest)) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    rows = []
    for i, text in docs:
        f = features(text, longest)
        weight = sum(gain(b) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    place = {k: n + 1 for n, k in enumerate(able[: len(able) * percent // 100])}
    return rows, able, place


def check(got, docs, target, **how):
    rows, able, place = brute(docs, target, **how)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted(((i, n, w, s) for i, _, n, w, s in rows), key=key)
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(able) * how.get("percent", 10) // 100 + 1))
    assert [(r.doc_id, r.score) for r in drawn] == [(r[0], r[4]) for r in able[: len(drawn)]]


@pytest.mark.parametrize("how", [{}, {"longest": 2, "percent": 35}, {"least": 1, "percent": 100}, {"percent": 0}])
def test_equals_a_plain_computation(spark, hard_docs, hard_rows, clashing, how):
    target = [hard_rows[0][1][:400], None, "", "plain target words ünïcode 42"]
    told = {"least_words" if k == "least" else k: v for k, v in how.items()}
    got = resampling.resample(hard_docs, clashing(spark.createDataFrame([(t,) for t in target], "text string")), **told).collect()
    check(got, hard_rows, target, **how)


def test_ties_go_to_the_smaller_id_and_repeated_ids_are_cut(spark):
    docs = [(k % 7, "w " * 30) for k in range(500)] + [(None, "w " * 30)] * 30
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("w",)], "text string"), percent=50).collect()
    check(got, docs, ["w"], percent=50)


@pytest.mark.parametrize("drawn", [1, 2, 5, 99, 100])
def test_cutoff_is_exact(spark, drawn):
    values = sorted((v * v % 83 - 40) * 10**15 for v in range(100))
    df = spark.createDataFrame([(v,) for v in values], "v long")
    from pyspark.sql import functions as F

    edge, above = resampling.cutoff(df, F.col("v"), drawn)
    assert edge == values[-drawn] and above == sum(v > edge for v in values)


def test_empty_tables(spark, no_docs, hard_docs, hard_rows):
    assert resampling.resample(no_docs, hard_docs).count() == 0
    check(resampling.resample(hard_docs, no_docs).collect(), hard_rows, [])
