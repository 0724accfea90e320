"""SimHash against brute force, covering masks, components, near-duplicate groups."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from texts import edited, prose

from tallywork.llm import simhash
from tallywork.llm.components import components


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius):
    """doc index -> least index reachable."""
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(k) for k in range(len(prints))]


def test_components_equal_brute_force(hard_docs, hard_rows):
    got = sorted(simhash.fingerprint_components(hard_docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.fingerprint))
    prints = [plain_print(t) for _, t in hard_rows]
    root = brute_components(prints, 4)
    least = {}
    for (i, _), r in zip(hard_rows, root):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = [(i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(hard_rows, prints, root)]
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_empty_table(no_docs):
    assert simhash.fingerprint_components(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0


@pytest.mark.parametrize("radius, bits", [(2, 16), (4, 32), (4, 64)])
def test_masks_cover_every_difference(radius, bits):
    masks = simhash.covering_masks(radius, bits)
    assert len(masks) == 2 ** (radius + 1) - 1
    r = random.Random(5)
    tries = itertools.combinations(range(bits), radius) if bits <= 32 else (r.sample(range(bits), radius) for _ in range(20_000))
    for flips in tries:
        changed = sum(1 << k for k in flips)
        assert any(not m & changed for m in masks)


def test_hot_bucket_in_blocks_gives_the_same_links(spark):
    r = random.Random(3)
    base = r.getrandbits(63)
    rows = [(1, base ^ sum(1 << k for k in r.sample(range(60), r.randint(0, 5)))) for _ in range(400)]
    df = spark.createDataFrame(rows, "bucket long, f0 long").distinct()
    whole = {(x.root, x.node) for x in components(simhash.link_buckets(df, ["f0"], 4, "f0")).collect()}
    old, simhash.BUCKET_ROWS = simhash.BUCKET_ROWS, 50
    try:
        cut = simhash.split_buckets(df, 50)
        assert cut.groupBy("bucket").count().agg({"count": "max"}).first()[0] <= 160
        parts = {(x.root, x.node) for x in components(simhash.link_buckets(cut, ["f0"], 4, "f0")).collect()}
    finally:
        simhash.BUCKET_ROWS = old
    assert parts == whole


def test_forest_connects_what_pairs_connect():
    r = np.random.default_rng(1)
    bucket = np.sort(r.integers(0, 6, 300))
    bits = (np.uint64(7) ^ (np.uint64(1) << r.integers(0, 60, (300, 6)).astype(np.uint64)).sum(axis=1, dtype=np.uint64))[:, None]
    for small in (2, 48, 400):
        root, row = simhash.forest(bucket, bits, 6, small)
        label = np.arange(300)
        label[row] = root
        same = [(a, b) for a, b in itertools.combinations(range(300), 2) if bucket[a] == bucket[b] and int(bits[a, 0] ^ bits[b, 0]).bit_count() <= 6]
        assert all(label[a] == label[b] for a, b in same)
        assert len(set(label.tolist())) == len(set(brute_labels(300, same)))


def brute_labels(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(1000, 1100)] + [(5, 5), (101, 100), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {7: 7} | {k: 7 for k in range(1000, 1100)}


def test_near_copies_leave_one(hard_docs, hard_rows):
    kept = sorted(r.doc_id for r in simhash.keep_one(hard_docs).collect() if r.doc_id is not None)
    gone = {6, 7, 8, 3, 4}  # copies and near copies of 1; texts without words are alike, and 2 is the first of them
    assert kept == sorted({i for i, _ in hard_rows if i is not None} - gone - {10})
    assert simhash.keep_one(hard_docs).columns == hard_docs.columns
    assert simhash.keep_one(hard_docs).filter("doc_id is null").count() == 2


def test_rows_of_one_id_with_other_texts_stay(spark, clashing):
    """One id, two texts: both stay unless each is like another row."""
    a, b = prose(50, 200), prose(51, 200)
    rows = [(1, a), (1, b), (2, edited(b, 120)), (3, prose(52, 200)), (3, prose(52, 200)), (3, edited(a, 150)), (None, a)]
    got = sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).collect())
    assert got == sorted([(0, a), (1, a), (1, b), (3, prose(52, 200))])
