"""Registry of named queries and of the SQL that checks them.

A query's columns are listed with a kind, so that both sides return the same
types: long, text (also dates), real (rounded) and flag.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import category_texts
from ..operators.commitments import commitment_board
from ..operators.detectors import detector_rows
from ..operators.recurring import merchant_patterns
from ..operators.scan import last_periods, look_back, posted_only
from ..plans import period_report as pr
from ..session import cut_lineage, drop, new_folder, scratch, store, write
from ..sources import driver_ledger, driver_rules
from . import check_sql

# Reals are compared in steps of one ten-thousandth, rounded by the same arithmetic on both sides.
REAL_STEPS, HALF = 10000.0, 0.5000001

# The columns that reports, pairing and refunds read.
REPORTED = ["owner_id", "account_id", "posted_at", "amount_cents", "description", "merchant", "fingerprint", "pending"]


class Inputs:
    """The ledger, the accounts and the user tables over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.as_of = driver_ledger.AS_OF

    @cached_property
    def ledger(self) -> DataFrame:
        return driver_ledger.ledger(self.spark, self.sf_dir)

    @cached_property
    def accounts(self) -> DataFrame:
        return driver_ledger.accounts(self.spark, self.sf_dir)

    @property
    def all_accounts(self) -> DataFrame:
        return driver_ledger.accounts(self.spark, self.sf_dir)

    @property
    def customers(self) -> DataFrame:
        return driver_ledger.spread_customers(self.spark, self.sf_dir)

    @cached_property
    def stored(self) -> DataFrame:
        """What reports read of the ledger, as a table. Here it is a view over three tables, so plans that scan it often write it first."""
        return store(self.ledger.select(*REPORTED))

    @cached_property
    def last_400_days(self) -> DataFrame:
        """The look-back of the recurrence rules as a table."""
        return store(look_back(self.ledger, self.as_of, 400))

    @cached_property
    def charges(self) -> DataFrame:
        """The 60 days and the few columns that detectors read, cut once for all of them."""
        return store(detector_rows(self.ledger, self.accounts, self.as_of))

    @cached_property
    def patterns(self) -> DataFrame:
        """Merchant patterns, computed once for the several rules that read them."""
        return cut_lineage(merchant_patterns(self.last_400_days, self.as_of))

    @cached_property
    def stored_patterns(self) -> DataFrame:
        """The same patterns for plans that have stored the ledger: its look-back is read from there."""
        return store(merchant_patterns(self.stored, self.as_of))

    @cached_property
    def board(self) -> DataFrame:
        """Commitments with what was posted for them, computed once."""
        return cut_lineage(commitment_board(self.rules("commitments"), self.ledger, self.as_of))

    @cached_property
    def event_ledger(self) -> DataFrame:
        return driver_ledger.event_ledger(self.spark, self.sf_dir)

    @cached_property
    def posted(self) -> DataFrame:
        return self.ledger.filter(posted_only())

    @cached_property
    def classified(self) -> DataFrame:
        """Typed by rules alone, categories looked up in the stored table of texts."""
        return pr.classified_ledger(self.ledger, self.accounts, texts=store(category_texts(self.ledger)))

    @cached_property
    def typed(self) -> DataFrame:
        return pr.classified_ledger(self.ledger, self.accounts, with_categories=False)

    def typed_months(self, months: int, as_of: str | None = None) -> DataFrame:
        """Typed rows of the last months only; the rest of the ledger is cut off before any rule runs."""
        return pr.classified_ledger(last_periods(self.ledger, as_of or self.as_of, months), self.accounts, with_categories=False)

    def classified_months(self, months: int, as_of: str | None = None) -> DataFrame:
        rows = last_periods(self.ledger, as_of or self.as_of, months)
        return pr.classified_ledger(rows, self.accounts, texts=store(category_texts(rows)))

    @cached_property
    def month_totals(self) -> DataFrame:
        """Totals of every ledger by the rules alone over the six months that reports and projections look back, computed once."""
        return cut_lineage(pr.period_totals(self.typed_months(6)))

    def rules(self, name: str, ledger: DataFrame | None = None) -> DataFrame:
        """A user table; one that is made from the ledger reads `ledger` if a stored one with its columns is given."""
        sql = driver_rules.VIEWS[name]
        used = {}
        if "{customer}" in sql:
            used["customer"] = self.customers
        if "{ledger}" in sql:
            used["ledger"] = self.ledger if ledger is None else ledger
        return self.spark.sql(sql, **used)

    def table(self, name: str) -> DataFrame:
        return driver_ledger.read_table(self.spark, self.sf_dir, name)


class Slice(Inputs):
    """The ledgers of one slice, stored, with the accounts and user tables of their owners. Slices by anything else have those of all."""

    def __init__(self, whole: Inputs, rows: DataFrame, by: str, number: int, count: int):
        super().__init__(whole.spark, whole.sf_dir)
        self.rows, self.by, self.number, self.count = rows, by, number, count

    def _own(self, table: DataFrame, owner: str) -> DataFrame:
        return table.filter(driver_ledger.share(self.count, owner) == self.number) if self.by == "owner_id" and self.count > 1 else table

    @property
    def ledger(self) -> DataFrame:
        return self.rows

    @property
    def stored(self) -> DataFrame:
        return self.rows.select(*REPORTED)

    @property
    def accounts(self) -> DataFrame:
        return self._own(self.all_accounts, "owner_id")

    @property
    def customers(self) -> DataFrame:
        return self._own(super().customers, "c_custkey")


def by_slices(x: Inputs, read: Sequence[str], by: str, build: Callable[[Inputs], DataFrame]) -> DataFrame:
    """What `build` makes of every slice of the ledgers, one after the other, as one table.

    No ledger is in two slices, and a query over them looks at one ledger at a time, so the rows are those of a single run. The
    columns `read` of the ledger are written once, in a folder a slice. A slice's folder, tables and shuffles are deleted as soon
    as its rows are written: on disk at once are what is left of the ledger, one slice's steps and the rows made so far."""
    spark, count = x.spark, driver_ledger.slice_count(x.spark, x.sf_dir)
    kept, made = new_folder(spark, "slices"), []
    with scratch(spark) as folder:
        ledger = f"{folder}/ledger"
        for part in driver_ledger.ledger_parts(spark, x.sf_dir):
            rows = part.select(*read, driver_ledger.share(count, by).alias("slice"))
            # Rows of an account side by side: its names compress to next to nothing.
            write(rows.sortWithinPartitions("slice", *[c for c in ("owner_id", "account_id") if c in read]), ledger, "slice")
        for number in range(count):
            with scratch(spark):
                own = spark.read.schema(rows.schema).parquet(ledger).filter(F.col("slice") == number).drop("slice")
                out = build(Slice(x, own, by, number, count))
                made.append(f"{kept}/{number}")
                write(out, made[-1])
            drop(spark, f"{ledger}/slice={number}")
    return spark.read.schema(out.schema).parquet(*made)


@dataclass(frozen=True)
class Query:
    build: Callable[[Inputs], DataFrame]
    columns: tuple[tuple[str, str], ...]
    check: str | None
    read: tuple[str, ...] = ()
    by: str = "owner_id"

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        x = Inputs(spark, sf_dir)
        return by_slices(x, self.read, self.by, self._rows) if self.read else self._rows(x)

    def _rows(self, x: Inputs) -> DataFrame:
        return self.build(x).select(*[_present(F.col(name), kind).alias(name) for name, kind in self.columns])

    def check_text(self) -> str:
        kinds = {
            "long": "CAST({} AS BIGINT)", "text": "CAST({} AS VARCHAR)", "flag": "CAST({} AS BOOLEAN)",
            "real": f"floor(CAST({{}} AS DOUBLE) * {REAL_STEPS} + {HALF}) / {REAL_STEPS}",
        }
        columns = ", ".join(f"{kinds[kind].format(name)} AS {name}" for name, kind in self.columns)
        return check_sql.with_parts(f"SELECT {columns} FROM ({self.check}) AS result")


def _present(col: Column, kind: str) -> Column:
    if kind == "real":
        return F.floor(col.cast("double") * REAL_STEPS + HALF) / REAL_STEPS
    return col.cast({"long": "bigint", "text": "string", "flag": "boolean"}[kind])


CATALOG: dict[str, Query] = {}


def query(columns: str, check: str | None = None, read: Sequence[str] = (), by: str = "owner_id"):
    """Registers the decorated function under its name. `columns` is 'name:kind ...', long where no kind is given.

    With `read`, columns of the ledger, it is run by slices of the ledgers, told by the column `by`; its ledger is a stored table."""
    spec = tuple((n, k or "long") for n, _, k in (w.partition(":") for w in re.split(r"\s+", columns.strip())))

    def add(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        CATALOG[build.__name__] = Query(build, spec, check, tuple(read), by)
        return build

    return add
