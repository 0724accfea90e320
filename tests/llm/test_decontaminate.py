"""Wu-Manber search against plain search."""

import hashlib
import random
import re

import pytest

from tallywork.llm import decontaminate


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=13):
    patterns = set()
    for i, t in items:
        w = plain(t)
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            patterns.add((str(i), tuple(w[k : k + window])))
    out = []
    for d, t in docs:
        w, hit, found = plain(t), set(), set()
        for i, p in patterns:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found.add(i)
        ids = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.fixture(scope="module")
def items(hard_rows):
    text = dict(hard_rows[13:])
    long = " ".join(text[100].split()[:40])
    return [(1, long), (2, long.upper() + "!"), (3, "One"), (4, None), (5, ""), (6, "ÇA va 東京"), (10, "tie tie tie"), (11, " ".join(text[101].split()[50:64])), (11, "tie tie")]


@pytest.mark.parametrize("at_once", [400_000, 9])
def test_equals_plain_search(spark, hard_docs, hard_rows, items, monkeypatch, at_once):
    monkeypatch.setattr(decontaminate, "PATTERNS_A_PASS", at_once)
    found = decontaminate.contamination(hard_docs, spark.createDataFrame(items, "item_id long, text string"))
    got = found.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest(found["items"]), "contaminated").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(brute(hard_rows, items), key=key)


def test_matcher_finds_overlapping_and_periodic_patterns():
    r = random.Random(2)
    for length in (1, 2, 3, 13):
        text = [r.randint(0, 2) for _ in range(500)]
        patterns = {tuple(text[k : k + length]): k for k in range(0, 480, 7)}
        want = [(k, patterns[tuple(text[k : k + length])]) for k in range(500 - length + 1) if tuple(text[k : k + length]) in patterns]
        assert list(decontaminate.WuManber(patterns).find(text)) == want


def test_clean_documents_stay_whole(spark, hard_docs, items):
    kept = decontaminate.without_contaminated(hard_docs, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == hard_docs.columns
    gone = {r.doc_id for r in hard_docs.collect()} - {r.doc_id for r in kept.collect()}
    assert gone == {9, 10, 11, 12, 100, 101}
    assert kept.filter("doc_id is null").count() == 2


def test_empty_tables(spark, hard_docs, no_docs, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(hard_docs, none).filter("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.contamination(no_docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_columns_of_the_caller_pass_through(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y"), (2, "d e f", "x", "y")], "doc_id long, text string, _row_key string, bad_key string")
    items = spark.createDataFrame([(7, "a b c")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.without_contaminated(docs, items).collect()] == [(2, "d e f", "x", "y")]
