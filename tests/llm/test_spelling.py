"""Spelling variants against brute force over all pairs of words."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from tallywork.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_words(rows, every=97):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def brute(words):
    out = {}
    around = {w: [] for w in words}
    for a, b in itertools.combinations(words, 2):
        if near(a, b):
            around[a].append(b)
            around[b].append(a)
    form = {w: min(v, key=lambda x: (-words[x], x)) for w, v in around.items() if v}
    form = {w: f for w, f in form.items() if words[f] >= 2 * words[w]}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, words[w], len(around[w]), words[form[w]] if w in form else None)
    return out


def found(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def made_words():
    """Few letters, so that many words are close; chains of growing counts; anagrams; a very long word and its neighbour."""
    r = random.Random(5)
    words = {"".join(r.choice("abcéÿ") for _ in range(r.randint(5, 9))): r.choice([3, 4, 7, 20, 60]) for _ in range(500)}
    words |= {"aaaaaaaaaa"[: 5 + k]: 3 * 3**k for k in range(5)}
    words |= {"".join(p): 5 for p in itertools.permutations("stone")}
    return words | {"x" * 3000: 4, "x" * 2999 + "y": 9, "÷×÷×÷": 3}


@pytest.mark.parametrize("most", [spelling.BLOCK_WORDS, 25])
def test_variants_equal_brute_force(spark, made_words, most):
    df = spark.createDataFrame(list(made_words.items()), "word string, n long")
    assert found(spelling.variants(df, most=most)) == brute(made_words)


def test_words_of_texts(spark, hard_rows, clashing):
    rows = hard_rows + [(500, "CAFÉS cafés Cafés cafésłcafés CAFés"), (501, "one-two,five5sixes fives " * 40), (502, "edited " * 300), (None, "Stonee stones STONE " * 30)]
    rows += [(600 + k, "variants of variant varjant words") for k in range(300)]
    shortened = next(k for k in range(2000, 4000) if zlib.crc32(f"{k}:unchanged".encode()) % 97 == 0)
    rows.append((shortened, "Unchanged " * 5))
    got = spelling.vocabulary(clashing(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {r.word: r.n for r in got.collect()} == brute_words(rows)
    assert any(n >= 3 and w not in " ".join(t or "" for _, t in rows).lower() for w, n in brute_words(rows).items())  # letters were deleted


def test_none(spark, no_docs):
    assert spelling.variants(spelling.vocabulary(no_docs)).count() == 0
    one = spark.createDataFrame([("alone", 3)], "word string, n long")
    assert found(spelling.variants(one)) == {"alone": (None, "alone", 3, 0, None)}
