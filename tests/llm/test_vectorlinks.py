"""Links among vectors against brute force over all pairs."""

import numpy as np
import pytest

from tallywork.llm import vectorlinks


def scaled(v):
    """By a power of two, which costs no digit; dividing by the largest component would."""
    v = np.array(v, float)
    return np.ldexp(v, -np.frexp(np.abs(v).max())[1])


def brute(rows, similarity=0.9):
    def ok(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    use = [k for k, (_, v) in enumerate(rows) if ok(v)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, a in enumerate(use):
        x = scaled(rows[a][1])
        for b in use[:n]:
            y = scaled(rows[b][1])
            if len(x) == len(y) and (x * y).sum() / (np.linalg.norm(x) * np.linalg.norm(y)) >= similarity:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if find(m) == find(k) and rows[m][0] is not None]
        least = min(ids) if ids else None
        out.append((i, links[k], least, i == least))
    return out


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=key) == sorted(want, key=key)


def clustered(seed, dims, groups, each, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dims))
    rows = [(c + spread * r.normal(size=dims) / np.sqrt(dims) * np.linalg.norm(c)).tolist() for c in centres for _ in range(each)]
    return [(k * 7 % 10007, v) for k, v in enumerate(rows)]


@pytest.mark.parametrize("chunk, block, fan", [(256, 32, 8), (8, 3, 2)])
def test_links_equal_brute_force(spark, clashing, monkeypatch, chunk, block, fan):
    for name, value in (("CHUNK", chunk), ("BLOCK", block), ("FAN", fan)):
        monkeypatch.setattr(vectorlinks, name, value)
    rows = clustered(3, 16, 40, 9, 0.35) + [(20000 + k, v) for k, (_, v) in enumerate(clustered(4, 16, 1, 150, 0.2))]
    rows += [(30000 + k, rows[0][1]) for k in range(60)]  # copies
    same(vectorlinks.vector_links(clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect(), brute(rows))


def test_distant_intervals_are_skipped():
    r = np.random.default_rng(0)
    at = np.repeat(np.arange(16.0), 2)[:, None] + r.random((32, 3)) * 0.1
    pairs = vectorlinks._near_chunks(at, at + 0.1, (0, 32), (0, 32), 0.45**2)
    assert len(pairs) == len(set(pairs)) == 16 * 3  # each meets itself and its one neighbour only


def test_odd_vectors(spark, clashing):
    rows = [
        (1, [1.0, 2.0, 0.5]), (2, [2.0, 4.0, 1.0]), (2, [2.0, 4.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, float("nan"), 1.0]),
        (7, [float("inf"), 0.0, 0.0]), (8, [1.0, None, 2.0]), (9, [1e200, 2e200, 5e199]), (10, [1e-200, 2e-200, 5e-201]), (None, [1.0, 2.0, 0.5]),
        (None, [-9.0, 1.0, 1.0]), (None, None), (11, [1.0, 2.0]), (12, [2.0, 4.0]), (13, [-1.0, -2.0, -0.5]), (14, [3.0]), (15, [5.0]), (16, [-5.0]), (17, [-0.0, 1.0, 0.0]), (18, [0.0, 1.0, 0.0]),
    ]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    same(vectorlinks.vector_links(df).collect(), brute(rows))
    assert vectorlinks.vector_links(df.limit(0)).count() == 0
    same(vectorlinks.vector_links(df.filter("vec_id IN (3, 4, 5)")).collect(), [(3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)])


def test_links_at_the_very_threshold(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [3.0, 4.0]), (4, [0.0, 1.0])]  # cosines of exactly 0.6 and 0.8
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    same(vectorlinks.vector_links(df, 0.6).collect(), brute(rows, 0.6))
    same(vectorlinks.vector_links(df, 0.8).collect(), brute(rows, 0.8))
