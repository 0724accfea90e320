"""Shards of near-equal bytes by histogram sort, with DataFrame functions alone.

Rows are ordered by one long key: 38 bits of a hash of the text, then 25 bits of a hash of the id and the row's number.
Equal texts are neighbours, and yet a text that a third of all rows share can be cut, also where the ids are equal or null. The boundaries between shards are found by exact
counts: each round counts the bytes below some probes around every boundary in all partitions at once and narrows the
interval, until each boundary is within the tolerance. Then the rows are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .common import named

GROUP_BITS, ALL_BITS = 25, 63
#: Probes a boundary and round. One round brings back (shards - 1) x PROBES + 1 sums, whatever the table's size.
PROBES = 12


def sort_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1; null: 1), text_crc32 (null as empty), key. The key holds a row number, so it is to be stored before use."""
    d = named(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    group = F.shiftrightunsigned(F.xxhash64("text"), 64 - (ALL_BITS - GROUP_BITS))
    row = F.shiftrightunsigned(F.xxhash64("doc_id", F.monotonically_increasing_id()), 64 - GROUP_BITS)
    return d.select(
        "doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32("text").alias("text_crc32"),
        F.shiftleft(group, GROUP_BITS).bitwiseOR(row).alias("key"),
    )


def _bin(key: Column, bounds: list[int], first: int, last: int) -> Column:
    """How many of the sorted bounds are at or below the key, by binary search."""
    if first == last:
        return F.lit(first)
    mid = (first + last) // 2
    return F.when(key < bounds[mid], _bin(key, bounds, first, mid)).otherwise(_bin(key, bounds, mid + 1, last))


def splitters(keys: DataFrame, shards: int = 8, tolerance: float = 0.01) -> tuple[list[int], list[int]]:
    """(boundaries, rows below each) for keys(key, size): shard i holds the keys from boundary i-1 up to boundary i.

    A boundary is taken between two texts where that is within `tolerance` of a shard's share, else between two rows of
    equal text, else (one row larger than the tolerance) at the nearer side of that row."""
    top = 1 << ALL_BITS
    total = keys.agg(F.sum("size"), F.count("*")).first()
    below = {0: (0, 0), top: (int(total[0] or 0), int(total[1]))}
    goals = [below[top][0] * s / shards for s in range(1, shards)]
    near = tolerance * below[top][0] / shards

    def bracket(goal: float) -> tuple[int, int]:
        at = sorted(below)
        return max(k for k in at if below[k][0] <= goal), min(k for k in at if below[k][0] >= goal)

    def best(goal: float) -> int:
        on_edge = [k for k in below if k % (1 << GROUP_BITS) == 0]
        error = lambda k: (abs(below[k][0] - goal), k)
        edge = min(on_edge, key=error)
        return edge if error(edge)[0] <= near else min(below, key=error)

    while True:
        probes: set[int] = set()
        for goal in goals:
            low, high = bracket(goal)
            if abs(below[best(goal)][0] - goal) <= near or below[high][1] - below[low][1] <= 1:
                continue
            for unit in (1 << GROUP_BITS, 1):  # between texts while there is a place between two texts
                first, last = (low + unit) // unit, (high - 1) // unit
                if first <= last:
                    break
            step = max(1, -(-(last - first + 1) // PROBES))
            probes |= {k * unit for k in range(first, last + 1, step)} | ({last * unit} if last >= first else set())
        probes -= below.keys()
        if not probes:
            break
        bounds = sorted(probes)
        got = keys.groupBy(_bin(F.col("key"), bounds, 0, len(bounds)).alias("bin")).agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
        sums = {r["bin"]: (r["size"], r["rows"]) for r in got}
        size = rows = 0
        for i, bound in enumerate(bounds):
            size, rows = size + sums.get(i, (0, 0))[0], rows + sums.get(i, (0, 0))[1]
            below[bound] = (size, rows)
    cuts = sorted(best(goal) for goal in goals)
    return cuts, [below[k][1] for k in cuts]


def shard_by_bytes(docs: DataFrame, shards: int = 8, tolerance: float = 0.01, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every row once, slots of a shard gapless from 0 in the order of the keys.

    Null and empty texts have size 1 and are one group; repeated rows each get a slot; a table with fewer rows than
    shards leaves shards empty; an empty table gives no rows."""
    keys = store(sort_keys(docs, doc_id, text))
    cuts, rows_below = splitters(keys, shards, tolerance)
    key = F.col("key")
    placed = keys.withColumn("shard", sum(((key >= k).cast("int") for k in cuts), F.lit(0)))
    # Within a task the id counts rows from 0; its upper bits are the task's number, which follows the order of the keys.
    placed = store(placed.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = placed.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in (0, *rows_below)]), F.col("shard") + 1)
    row = F.col("at").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(tasks), part == tasks["part"]).select(  # one row a task
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + row - start).cast("long").alias("slot")
    )
