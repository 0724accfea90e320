"""Histogram-sort shards: exact sizes, gapless slots, hot texts."""

import zlib

from tallywork.llm import sharding


def checked(rows, shards):
    """Sizes of the shards, after checking slots."""
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    return [sum(r.size for r in by.get(k, [])) for k in range(shards)]


def test_every_row_once_with_size_and_checksum(hard_docs, hard_rows):
    rows = sharding.shard_by_bytes(hard_docs).collect()
    checked(rows, 8)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in hard_rows]
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in rows), key=key) == sorted(want, key=key)


def test_sizes_are_near_equal_and_copies_stay_together(spark):
    rows = [(k, "x" * (50 + k % 40) + str(k // 5)) for k in range(4000)]
    placed = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = checked(placed, 8)
    assert max(sizes) <= 1.03 * min(sizes)
    text = dict(rows)
    shards = {}
    for r in placed:
        shards.setdefault(text[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 7


def test_one_text_of_a_third_of_the_rows_is_cut(spark):
    rows = [(k, "the same text" if k % 3 == 0 else f"text number {k}") for k in range(6000)]
    sizes = checked(sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect(), 8)
    assert max(sizes) <= 1.03 * min(sizes)


def test_few_rows_repeated_rows_and_none(spark, no_docs):
    rows = sharding.shard_by_bytes(spark.createDataFrame([(1, "a")] * 3, "doc_id long, text string")).collect()
    assert len(rows) == 3
    checked(rows, 8)
    assert sharding.shard_by_bytes(no_docs).count() == 0


def test_repeated_rows_are_cut(spark):
    """A third of the rows have one text and no id, or one text and one id."""
    for copied in (None, 7):
        rows = [(copied, "one text, many times " * 3)] * 3000 + [(100 + k, f"text number {k} " * (k % 5)) for k in range(6000)]
        placed = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        sizes = checked(placed, 8)
        assert len(placed) == 9000 and max(sizes) <= 1.03 * min(sizes)


def test_no_python_in_the_plan(hard_docs):
    plan = sharding.shard_by_bytes(hard_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
