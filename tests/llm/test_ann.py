"""Permutation index against brute force."""

import numpy as np
import pytest

from tallywork.llm import ann


def brute(rows, every, k):
    out = {}
    for q, v in rows.items():
        if q % every == 0:
            v = np.array(v, float)
            score = {i: float((v * x).sum() / np.sqrt((x * x).sum() * (v * v).sum())) for i, y in rows.items() if i != q for x in [np.array(y, float)]}
            out[q] = sorted(score.items(), key=lambda s: (-round(s[1], 12), s[0]))[:k]
    return out


def found(df, every=50):
    out = {}
    for r in sorted(ann.nearest_neighbours(df, every).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_scores(spark, clashing):
    r = np.random.default_rng(0)
    rows = {k: r.normal(size=32).astype("float32").tolist() for k in range(6000)}
    df = clashing(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>"))
    got, want = found(df), brute(rows, 50, 5)
    assert got.keys() == want.keys()
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert sum(hits) / (5 * len(want)) >= 0.9
    for q, pairs in got.items():
        exact = dict(brute({q: rows[q]} | {i: rows[i] for i, _ in pairs}, q or 50, 9).get(q, []))
        assert all(s == pytest.approx(exact[i], abs=1e-12) for i, s in pairs)


def test_copies_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ann, "QUERY_ROWS", 2)
    r = np.random.default_rng(1)
    rows = {k: [1.0, 2.0, 0.5] if k % 3 == 0 else r.normal(size=3).round(3).tolist() for k in range(300)}
    odd = [(1001, None), (1002, []), (1003, [0.0, 0.0, 0.0]), (1050, [1.0, float("nan"), 1.0]), (1100, [1.0, float("inf"), 0.0]), (1150, [1.0, None, 2.0]), (None, [1.0, 1.0, 1.0]), (1200, [1.0, 2.0])]
    df = spark.createDataFrame([*rows.items(), *list(rows.items())[:40], *odd], "vec_id long, embedding array<double>")
    got = found(df)
    want = brute(rows, 50, 5)
    assert {q: [i for i, _ in p] for q, p in got.items()} == {q: [i for i, _ in p] for q, p in want.items()}


def test_fewer_rows_than_asked_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1e200, 1e200]), (3, [-1.0, 1e-200])], "vec_id long, embedding array<double>")
    got = found(few)
    assert [i for i, _ in got[0]] == [2, 1, 3] and got[0][0][1] == pytest.approx(2**-0.5)
    assert ann.nearest_neighbours(few.limit(0)).count() == 0
    assert ann.nearest_neighbours(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")).count() == 0
