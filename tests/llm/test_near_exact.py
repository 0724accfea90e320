"""The near-duplicate stage against brute-force Jaccard around its threshold."""

import itertools
import random

from tallywork.llm import simhash


def shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_groups_equal_brute_force_around_the_threshold(spark):
    r = random.Random(8)
    docs, pairs = {}, []
    for k in range(300):
        words = [f"w{r.randrange(10**6)}" for _ in range(r.randint(150, 400))]
        goal = 0.74 + 0.17 * k / 300
        other, at = list(words), list(range(2, len(words) - 2, 6))
        r.shuffle(at)
        while at and jaccard(" ".join(words), " ".join(other)) > goal:
            other[at.pop()] = f"x{r.randrange(10**6)}"
        docs[2 * k], docs[2 * k + 1] = " ".join(words), " ".join(other)
        pairs.append((2 * k, jaccard(docs[2 * k], docs[2 * k + 1])))
    group = {x.doc_id: x.group_id for x in simhash.similar_groups(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    linked = {a: group[a] == group[a + 1] for a, _ in pairs}
    assert not any(linked[a] for a, j in pairs if j < 0.8)
    near = [linked[a] for a, j in pairs if j >= 0.8]
    assert len(near) > 150 and sum(near) >= 0.98 * len(near)


def test_sets_in_blocks_give_the_same_links(spark, monkeypatch):
    r = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    docs = []
    for k in range(60):
        words = list(base)
        for _ in range(r.randint(0, 6)):
            words[r.randrange(120)] = f"x{r.randrange(10**6)}"
        docs.append((k, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole = sorted(simhash.similar_groups(df).collect())
    monkeypatch.setattr(simhash, "BLOCK_SETS", 7)
    assert sorted(simhash.similar_groups(df).collect()) == whole
    root = list(range(60))
    for _ in range(60):
        for a, b in itertools.combinations(range(60), 2):
            if jaccard(docs[a][1], docs[b][1]) >= 0.8:
                root[a] = root[b] = min(root[a], root[b])
    assert sum(dict(whole)[k] != root[k] for k in range(60)) <= 1
