"""Passages as wholes: short lines are never missed, lines that repeat alone stay, the first copy stays whole."""

from tallywork.llm import lines

from texts import prose


def cleaned(spark, docs):
    return {r.doc_id: r.text for r in lines.without_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}


def test_no_copy_of_short_lines_is_missed(spark):
    docs, passages = {}, {}
    for n in range(4, 11):
        for k in range(6):
            passage = prose(100 * n + k, 60, -(-60 // n))
            for copy in range(2):
                key = 1000 * n + 10 * k + copy
                docs[key], passages[key] = f"{prose(7 * key, 14, 14)}\n{passage}\n{prose(7 * key + 1, 14, 14)}", passage
    got = cleaned(spark, docs)
    for key, passage in passages.items():
        assert got[key] == (docs[key] if key % 10 == 0 else docs[key].replace(passage + "\n", ""))


def test_lines_that_repeat_alone_and_first_copies_stay(spark):
    a, b, c, x, y, z = (prose(k, 20, 20) for k in range(6))
    own = [prose(50 + k, 9, 9) for k in range(12)]
    docs = {1: f"{own[0]}\n{a}", 2: f"{b}\n{own[1]}", 3: f"{own[2]}\n{c}", 7: f"{own[3]}\n{a}\n{b}\n{c}"}
    docs |= {10: f"{own[4]}\n{x}\n{own[5]}", 11: f"{x}\n{y}\n{z}", 12: f"{own[6]}\n{x}\n{y}\n{z}\n{own[7]}"}
    docs |= {20: "\n".join([own[8]] * 30), 21: f"{a}\n\n{x}\n\n{c}", 22: f"{own[9]}\n{a}\n\n{x}\n\n{c}"}
    got = cleaned(spark, docs)
    assert got == docs | {12: f"{own[6]}\n{own[7]}", 20: "\n".join([own[8]] * 6), 22: own[9]}


def test_many_lines_gone_and_columns_of_the_same_names(spark):
    from pyspark.sql import functions as F

    passage = "\n".join(f"line {k} of the long one" for k in range(30_000))
    docs = spark.createDataFrame([(1, passage), (2, f"own\n{passage}\nlast")], "doc_id long, text string")
    clashing = {c: F.lit("caller's") for c in ("lines_before", "lines_dropped", "_drop", "_drop_id", "items", "places")}
    out = lines.without_repeats(docs.withColumns(clashing))
    assert out.columns == ["doc_id", "text", "_drop", "_drop_id", "items", "places", "lines_before", "lines_dropped"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == passage and got[1].lines_dropped == 0
    assert got[2].text == "own\nlast" and (got[2].lines_before, got[2].lines_dropped) == (30_002, 30_000) and got[2]["_drop"] == "caller's"
