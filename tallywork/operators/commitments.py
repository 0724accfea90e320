"""Commitments: user-confirmed recurring items and what the ledger says about them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..lexicon import keywords as kw
from ..session import store
from .scan import KEYS, with_merchant_norm
from .stats import day_gaps, exact_median

# Band of a deposit's median gap in days.
INCOME_BANDS = [("weekly", 5, 10), ("biweekly", 11, 18), ("monthly", 19, 35), ("quarterly", 80, 100)]
# Days until the next charge is expected.
EXPECTED_DAYS = {"weekly": 7, "biweekly": 14, "monthly": 30, "bimonthly": 60, "quarterly": 91, "annual": 365}


def _merchant_rows(commitments: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Commitments joined to the rows of their merchant and direction."""
    rows = ledger.select(
        *keys, F.lower("merchant").alias("merchant_key"), "posted_at", "amount_cents", "fingerprint",
        F.when(F.col("amount_cents") < 0, F.lit("expense")).when(F.col("amount_cents") > 0, F.lit("income")).alias("direction"))
    items = commitments.withColumn("merchant_key", F.lower("merchant_norm"))
    return items.join(rows, [*keys, "merchant_key", "direction"])


def recent_middle(rows: DataFrame, item: Sequence[str]) -> DataFrame:
    """Middle absolute amount of the three newest rows per item."""
    newest = Window.partitionBy(*item).orderBy(F.desc("posted_at"), "fingerprint")
    top = rows.withColumn("place", F.row_number().over(newest)).filter("place <= 3")
    amounts = F.sort_array(F.collect_list(F.abs("amount_cents")))
    return top.groupBy(*item).agg(F.get(amounts, F.floor(F.size(amounts) / 2).cast("int")).alias("recent_cents"))


def matching_rows(commitments: DataFrame, ledger: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Ledger rows that fit a commitment (id, merchant_norm, expected_cents, day_of_month, source, direction).

    The amount lies within half to one and a half times the anchor, the day
    within three of the due day, and, unless entered by hand, four months hit.
    """
    item = [*keys, "commitment_id"]
    rows = store(_merchant_rows(commitments, ledger, keys))  # read three times below; the ledger is shuffled once
    fitting = rows.join(recent_middle(rows, item), item).withColumn(
        "anchor", F.abs(F.coalesce("expected_cents", "recent_cents")))
    size = F.abs("amount_cents")
    due = F.least(F.col("day_of_month"), F.dayofmonth(F.last_day("posted_at")))
    on_day = F.col("day_of_month").isNull() | (F.abs(F.dayofmonth("posted_at") - due) <= 3)
    fitting = fitting.filter(
        (size >= F.floor(F.col("anchor") * 0.5)) & (size <= F.floor(F.col("anchor") * 1.5)) & on_day)
    months = fitting.groupBy(*item).agg(F.count_distinct(F.trunc("posted_at", "month")).alias("months_seen"))
    return fitting.join(months, item).filter((F.col("source") == "manual") | (F.col("months_seen") >= 4)).select(
        *item, "name", "direction", "posted_at", "amount_cents", "fingerprint", "anchor", "months_seen")


def with_resolved_amount(commitments: DataFrame, ledger: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds resolved_cents: the stated amount, else the middle of the three newest matches."""
    item = [*keys, "commitment_id"]
    open_items = commitments.filter("expected_cents is null")
    found = recent_middle(matching_rows(open_items, ledger, keys), item)
    return commitments.join(found, item, "left").withColumn(
        "resolved_cents", F.coalesce("expected_cents", "recent_cents")).drop("recent_cents")


def commitment_board(commitments: DataFrame, ledger: DataFrame, as_of: str | dt.date, keys: Sequence[str] = KEYS) -> DataFrame:
    """Commitments with status, monthly equivalent and next due date."""
    status = (
        F.when(F.col("source") == "dismissed", F.lit("dismissed"))
        .when(F.col("confirmed"), F.lit("confirmed")).otherwise(F.lit("suggested"))
    )
    return with_resolved_amount(commitments, ledger, keys).select(
        *keys, "commitment_id", "name", "merchant_norm", "direction", "cadence", "resolved_cents", status.alias("status"),
        money.commitment_monthly_equivalent(F.col("resolved_cents"), F.col("cadence")).alias("monthly_cents"),
        dates.next_due(F.col("cadence"), F.col("day_of_month"), F.col("reference_date"), dates.as_date(as_of)).alias("next_due"),
    )


def board_totals(board: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Confirmed monthly income, expense and net per ledger."""
    confirmed = F.when(F.col("status") == "confirmed", F.col("monthly_cents")).otherwise(F.lit(0))

    def side(direction: str):
        return F.sum(F.when(F.col("direction") == direction, confirmed).otherwise(F.lit(0)))

    return board.groupBy(*keys).agg(
        side("income").alias("income_cents"), side("expense").alias("expense_cents"),
        (side("income") - side("expense")).alias("net_cents"))


def not_yet_posted(
    recurring: DataFrame, ledger: DataFrame, as_of: str | dt.date, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Recurring merchants 8 to 90 days past their expected date and without a row this month.

    `recurring` has merchant_norm, cadence, monthly_cents, last_seen.
    """
    today = dates.as_date(as_of)
    step = F
    for name, n in EXPECTED_DAYS.items():
        step = step.when(F.col("cadence") == name, F.lit(n))
    late = recurring.withColumn("expected_date", F.date_add("last_seen", step.otherwise(F.lit(30)))).filter(
        F.datediff(today, "expected_date").between(8, 90))
    this_month = with_merchant_norm(ledger.filter(
        dates.in_range(F.col("posted_at"), F.trunc(today, "month"), F.date_add(today, 1))
        & ~F.coalesce("pending", F.lit(False)))).select(*keys, "merchant_norm")
    return late.join(this_month, [*keys, "merchant_norm"], "left_anti").select(
        *keys, "merchant_norm", "cadence", "monthly_cents", "last_seen", "expected_date")


def income_merchants(ledger: DataFrame, income_rules: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Merchants with deposits in two or more months, their cadence and middle amount.

    Ledgers with income rules use those; the others use payroll words.
    """
    merchant = [*keys, "merchant_norm"]
    rows = ledger.filter("amount_cents > 0 and merchant is not null and merchant <> ''").select(
        *keys, F.trim(F.lower("merchant")).alias("merchant_norm"), "posted_at", "amount_cents")
    worded = text.contains_any(F.col("merchant_norm"), kw.SUGGEST_INCOME)
    if income_rules is None:
        chosen = rows.filter(worded)
    else:
        ruled = income_rules.select(*keys).distinct()
        hits = rows.select(*merchant).distinct().join(income_rules, list(keys)).filter(
            F.contains("merchant_norm", F.lower("merchant_pattern"))).select(*merchant).distinct()
        chosen = rows.join(hits, merchant, "left_semi").unionByName(rows.filter(worded).join(ruled, list(keys), "left_anti"))
    counted = chosen.groupBy(*merchant, "posted_at", "amount_cents").agg(F.count("*").alias("n"))
    days = counted.groupBy(*merchant, "posted_at").agg(F.sum("n").alias("n"))
    gaps = day_gaps(days, merchant).groupBy(*merchant).agg(F.percentile("gap", F.lit(0.5), F.col("n")).alias("gap"))
    label = F
    for name, low, high in INCOME_BANDS:
        label = label.when(F.col("gap").between(low, high), F.lit(name))
    seen = days.groupBy(*merchant).agg(
        F.count_distinct(F.trunc("posted_at", "month")).alias("months"), F.max("posted_at").alias("last_seen"))
    medians = exact_median(counted.groupBy(*merchant, "amount_cents").agg(F.sum("n").alias("n")), merchant, "amount_cents", "n", "middle")
    return seen.filter("months >= 2").join(gaps, merchant, "left").join(medians, merchant).select(
        *merchant, label.otherwise(F.lit("monthly")).alias("cadence"), F.col("middle").cast("bigint").alias("expected_cents"))


def suggestions(
    subscriptions: DataFrame,
    bills: DataFrame,
    income: DataFrame,
    ledger: DataFrame,
    existing: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """New commitment suggestions; merchants already on the board in that direction are left out.

    A merchant that is both a subscription and a bill is suggested as the former.
    """
    merchant = [*keys, "merchant_norm"]
    subs = subscriptions.select(
        *merchant, F.coalesce("display_name", "merchant_norm").alias("name"), F.col("charge_cents").alias("expected_cents"),
        "cadence", F.lit("expense").alias("direction"), F.lit(0).alias("rank"))
    dues = bills.select(*merchant, F.col("merchant_norm").alias("name"), F.col("monthly_cents").alias("expected_cents"),
                        "cadence", F.lit("expense").alias("direction"), F.lit(1).alias("rank"))
    paid = income.select(*merchant, F.col("merchant_norm").alias("name"), "expected_cents", "cadence",
                         F.lit("income").alias("direction"), F.lit(2).alias("rank"))
    every = subs.unionByName(dues).unionByName(paid).filter("merchant_norm <> ''")
    best = every.groupBy(*merchant, "direction").agg(
        F.min_by(F.struct("name", "expected_cents", "cadence"), "rank").alias("s")).select(*merchant, "direction", "s.*")
    if existing is not None:
        have = existing.select(*keys, F.lower("merchant_norm").alias("merchant_norm"), "direction")
        best = best.join(have, [*merchant, "direction"], "left_anti")
    newest = ledger.groupBy(*keys, F.lower("merchant").alias("merchant_norm")).agg(F.max("posted_at").alias("reference_date"))
    return best.join(newest, merchant, "left")
