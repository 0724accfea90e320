"""One-to-one matching by preference, over lots.

A lot is a set of rows alike in everything the match looks at, with a count.
Lots are matched with their counts, so n copies are one candidate, never n times n.

Proposers act in one global order and each takes its best partner that is still
free. Choices reach no further than the connected component of a candidate, and
never beyond its ledger, so ledgers are searched side by side, each in one pass
over its sorted candidates. A ledger of very many candidates is parted into its
components; only a component that is still too large is matched in rounds, in
which a proposer and a partner that are first choice for each other are settled
and spent lots leave. Both ways give the same pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, store
from .components import components

# Slices of a lot when its rows are numbered: the first letters of a hash.
SLICE_LETTERS = 3
# Candidates that are searched in one pass of one task; the task keeps only the lots that it has used up in part.
SERIAL_MOST = 500_000


def row_slice(row_id: Column) -> Column:
    return F.substring(F.md5(row_id), 1, SLICE_LETTERS)


def assign(candidates: DataFrame, score: Column, partner_order: Column, proposer_order: Column, keys: Sequence[str]) -> DataFrame:
    """Settled pairs (proposer, partner, quantity, round) of lots.

    `candidates` has the ledger's keys, proposer and partner lot ids, their counts
    proposer_n and partner_n, and the columns the orders read. The best partner has
    the highest score, then the lowest partner_order; both orders are total. `round`
    grows in the order in which a lot's units are taken. The candidates are read
    more than once, so the caller passes checkpointed ones.
    """
    rows = candidates.select(
        F.xxhash64(*keys).alias("part"), "proposer", "partner", F.col("proposer_n").cast("long").alias("proposer_n"),
        F.col("partner_n").cast("long").alias("partner_n"), F.struct(-score, partner_order).alias("choice"), proposer_order.alias("turn"))
    if _over(rows, "part").isEmpty():
        return _serial(rows)
    large = store(_over(rows, "part"))
    small = rows.join(large, "part", "left_anti")
    big = rows.join(large, "part", "left_semi")
    nodes = {side: F.xxhash64(F.lit(side), side) for side in ("proposer", "partner")}
    roots = components(big.select(nodes["proposer"].alias("a"), nodes["partner"].alias("b")))
    big = store(big.join(roots, nodes["proposer"] == roots["node"]).withColumn("part", F.col("root")).select(*rows.columns))
    giant = store(_over(big, "part"))
    settled = _serial(small.unionByName(big.join(giant, "part", "left_anti")))
    if giant.isEmpty():
        return settled
    return settled.unionByName(_in_rounds(big.join(giant, "part", "left_semi").drop("part")))


def _over(rows: DataFrame, part: str) -> DataFrame:
    """Parts of more candidates than one pass should hold."""
    return rows.groupBy(part).count().filter(F.col("count") > SERIAL_MOST).select(part)


def _serial(rows: DataFrame) -> DataFrame:
    """The serial search itself, a part at a time, over candidates in the order of turns and choices."""
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, place = None, {}, 0
        for batch in batches:
            out: list[tuple] = []
            for part, proposer, partner, wanted, free in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    now, left = part, {}
                want, have = left.get((0, proposer), wanted), left.get((1, partner), free)
                if want and have:
                    taken = min(want, have)
                    left[0, proposer], left[1, partner] = want - taken, have - taken
                    place += 1
                    out.append((proposer, partner, taken, place))
            if out:
                columns = [pa.array(x) for x in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, names=["proposer", "partner", "quantity", "round"])

    ordered = rows.repartition("part").sortWithinPartitions("part", "turn", "choice")
    narrow = ordered.select("part", "proposer", "partner", "proposer_n", "partner_n")
    return store(narrow.mapInArrow(search, "proposer string, partner string, quantity long, round long"))


def _in_rounds(rows: DataFrame) -> DataFrame:
    """The same by rounds of first choices. The proposer that comes first overall is always settled, so every round makes progress."""
    live, settled, number = rows, None, 0
    while not live.isEmpty():
        number += 1
        # A popular lot's candidates are reduced by partial aggregation, never brought together in one task.
        best = live.groupBy("proposer").agg(F.min("choice").alias("choice"))
        first = live.groupBy("partner").agg(F.min("turn").alias("turn"))
        chosen = live.join(best, ["proposer", "choice"]).join(first, ["partner", "turn"])
        pairs = cut_lineage(chosen.select(
            "proposer", "partner", F.least("proposer_n", "partner_n").alias("quantity"), F.lit(number).cast("long").alias("round")))
        settled = pairs if settled is None else settled.unionByName(pairs)
        # A lot settles with at most one other in a round, so each side has one row here.
        taken = [pairs.select(side, F.col("quantity").alias(f"{side}_taken")) for side in ("proposer", "partner")]
        live = live.join(taken[0], "proposer", "left").join(taken[1], "partner", "left")
        for side in ("proposer", "partner"):
            live = live.withColumn(f"{side}_n", F.col(f"{side}_n") - F.coalesce(f"{side}_taken", F.lit(0))).drop(f"{side}_taken")
        live = cut_lineage(live.filter("proposer_n > 0 and partner_n > 0").select(*rows.columns))
    return settled


def numbered(rows: DataFrame, lot: str, row_id: str) -> DataFrame:
    """Adds place, 0-based within the lot in (slice, hash, id) order, without ordering a lot in one task.

    Rows without an id take the first places of their lot and are left out. The slice is never null: the join on it then adds
    no filter of its own to one of the two readings of `rows`, so that both share one exchange."""
    sliced = rows.withColumn("slice", F.coalesce(row_slice(F.col(row_id)), F.lit("")))
    sizes = sliced.groupBy(lot, "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(lot).orderBy("slice")) - F.col("n")
    starts = sizes.select(lot, "slice", before.alias("start"))
    order = Window.partitionBy(lot, "slice").orderBy(F.md5(row_id), row_id)
    return (
        sliced.withColumn("place", F.row_number().over(order) - 1)
        .join(starts, [lot, "slice"])
        .withColumn("place", F.col("place") + F.col("start"))
        .filter(F.col(row_id).isNotNull())
        .drop("slice", "start")
    )


def expand(settled: DataFrame, proposers: DataFrame, partners: DataFrame) -> DataFrame:
    """Row pairs (proposer_row, partner_row, proposer, partner) of settled lots.

    `proposers` and `partners` are (lot, row_id). Each settled quantity takes the
    next places of both lots.
    """
    def ranges(side: str) -> Column:
        taken = Window.partitionBy(side).orderBy("round", "proposer", "partner")
        return F.sum("quantity").over(taken) - F.col("quantity")

    spans = settled.withColumn("proposer_from", ranges("proposer")).withColumn("partner_from", ranges("partner"))

    def units(rows: DataFrame, side: str) -> DataFrame:
        used = rows.join(settled.select(F.col(side).alias("lot")).distinct(), "lot", "left_semi")
        placed = numbered(used, "lot", "row_id").withColumnsRenamed({"lot": side, "row_id": f"{side}_row"})
        each = spans.select("proposer", "partner", F.col(f"{side}_from").alias("first"), F.explode(F.sequence(F.lit(0), F.col("quantity") - 1)).alias("unit"))
        each = each.select("proposer", "partner", "unit", (F.col("first") + F.col("unit")).alias("place"))
        return placed.join(each, [side, "place"]).select("proposer", "partner", f"{side}_row", "unit")

    return units(proposers, "proposer").join(units(partners, "partner"), ["proposer", "partner", "unit"]).drop("unit")


def lot_id(*columns: str) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def band(value: Column, width: int) -> Column:
    """Number of the band of that width that holds the value."""
    return F.floor(value / width).cast("bigint")


def bands_near(value: Column, reach: int, width: int) -> Column:
    """Bands that meet [value - reach, value + reach]."""
    return F.sequence(band(value - reach, width), band(value + reach, width))


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def key_text(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).cast("string") for k in keys]
