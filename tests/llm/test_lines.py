"""Passages that repeat across documents go; everything else stays."""

import itertools
import random

from tallywork.llm import lines

from texts import prose


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_shared_passages_go_but_for_the_first(hard_docs, hard_rows):
    out = lines.without_repeats(hard_docs)
    assert out.columns == [*hard_docs.columns, "lines_before", "lines_dropped"]
    got = rows_of(out.filter("doc_id is not null").dropDuplicates(["doc_id"]))
    text = {i: t for i, t in hard_rows if i is not None}
    shared = prose(2, 80, 20)
    assert got[13].text == text[13] and shared not in got[14].text
    assert got[14].text == text[14].replace("\n" + shared, "") and got[14].lines_dropped == 4
    assert got[1].text == text[1] and got[6].text == ""
    assert got[2].text is None and got[2].lines_before == 0 and got[3].text == "" and got[4].text == text[4]
    assert all(got[k].text == text[k] for k in range(100, 120))
    assert out.count() == len(hard_rows)


def test_passages_in_any_position_are_found(spark):
    """Passages of several shapes among lines of their own: none of over 50 words is left twice, no other line is lost."""
    r = random.Random(4)
    shapes = [(60,), (26, 26), (18, 18, 18), (9,) * 7, (30, 10, 15), (5,) * 14]
    passages = ["\n".join(prose(50 + 10 * s + k, n, n) for k, n in enumerate(shape)) for s, shape in enumerate(shapes)]
    docs = {}
    for k, passage in itertools.product(range(6), range(len(passages))):
        own = [prose(1000 + 97 * k + 7 * passage + j, n := r.randint(3, 30), n) for j in range(6)]
        docs[10 * k + passage] = "\n".join([*own[:3], passages[passage], *own[3:]])
    got = rows_of(lines.without_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string")))
    left = [sum(p in got[i].text for i in docs) for p in passages]
    assert left[0] == left[1] == left[2] == left[4] == 1 and sum(left) <= len(left) + 1
    for i, text in docs.items():
        lost = set(text.split("\n")) - set(got[i].text.split("\n"))
        assert lost <= set(passages[i % 10].split("\n"))


def test_short_repeats_and_near_misses_stay(spark):
    a, b = prose(1, 45, 15), prose(2, 60, 15)
    rows = [(1, a + "\nx"), (2, a + "\ny"), (3, b), (4, b.replace(" ", "  "))]
    got = rows_of(lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r.text for i, r in got.items()} == dict(rows)


def test_ties_empty_table_and_native_plan(spark, no_docs, hard_docs):
    passage = prose(3, 70, 14)
    got = rows_of(lines.without_repeats(spark.createDataFrame([(1, passage + "\n" + passage), (2, passage)], "doc_id long, text string")))
    assert got[1].text == passage and got[2].text == ""
    assert lines.without_repeats(no_docs).count() == 0
    plan = lines.without_repeats(hard_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
