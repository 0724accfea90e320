"""Ledger scans: the filters every report starts from."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text

KEYS = ("owner_id",)


def with_merchant_norm(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("merchant_norm", text.merchant_norm(F.col("merchant"), F.col("description")))


def posted_only() -> Column:
    return ~F.coalesce(F.col("pending"), F.lit(False))


def for_accounts(ledger: DataFrame, accounts: Sequence[str] | DataFrame | None) -> DataFrame:
    """None keeps all rows; an empty choice keeps none. A choice is a list of ids, or a table with account_id."""
    if accounts is None:
        return ledger
    if isinstance(accounts, DataFrame):
        return ledger.join(accounts.select("account_id").distinct(), "account_id", "left_semi")
    return ledger.filter(F.col("account_id").isin(list(accounts)) if accounts else F.lit(False))


def for_accounts_or_all(ledger: DataFrame, accounts: Sequence[str] | None) -> DataFrame:
    """Detector variant: an empty choice means all accounts."""
    return for_accounts(ledger, accounts or None)


def period_scan(
    ledger: DataFrame,
    start: str | dt.date,
    end: str | dt.date,
    accounts: Sequence[str] | None = None,
    include_pending: bool = False,
) -> DataFrame:
    """Rows of [start, end), posted ones unless asked otherwise."""
    rows = for_accounts(ledger.filter(dates.in_range(F.col("posted_at"), start, end)), accounts)
    return with_merchant_norm(rows if include_pending else rows.filter(posted_only()))


def inclusive_scan(ledger: DataFrame, first: str | dt.date, last: str | dt.date, **options) -> DataFrame:
    """Rows of a range whose last day is named by the user and included."""
    end = dt.date.fromisoformat(str(last)) + dt.timedelta(days=1)
    return period_scan(ledger, first, end, **options)


def user_ranges(ledger: DataFrame, ranges: DataFrame, include_pending: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of each range that a table of (keys, range_id, first_day, last_day) names; both days belong to the range.

    Ranges meet the ledger month by month, so a row is compared with the ranges of its own month only. They are never
    broadcast: before they are spread over their months the planner takes them for far smaller than they are."""
    rows = ledger if include_pending else ledger.filter(posted_only())
    months = F.sequence(F.trunc("first_day", "month"), F.trunc("last_day", "month"), F.make_interval(months=F.lit(1)))
    spans = ranges.filter(F.col("first_day") <= F.col("last_day")).select(*keys, "range_id", "first_day", "last_day", F.explode(months).alias("range_month"))
    inside = rows.withColumn("range_month", F.trunc("posted_at", "month")).join(spans.hint("merge"), [*keys, "range_month"])
    return inside.filter(dates.in_range(F.col("posted_at"), F.col("first_day"), dates.exclusive_end(F.col("last_day")))).drop("range_month")


def user_range_totals(ledger: DataFrame, ranges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows, income, spending and length of each range, and where its last day lies in its month; ranges without rows stay."""
    amount, scope = F.col("amount_cents"), [*keys, "range_id"]
    sums = user_ranges(ledger, ranges, keys=keys).groupBy(*scope).agg(
        F.count("*").alias("row_count"), F.sum(F.when(amount > 0, amount).otherwise(0)).alias("income_cents"),
        F.sum(F.when(amount < 0, -amount).otherwise(0)).alias("spend_cents"))
    last = F.col("last_day")
    return (
        ranges.join(sums.hint("merge"), scope, "left").na.fill(0, ["row_count", "income_cents", "spend_cents"])
        .withColumns({"days": dates.days_in_range(F.col("first_day"), dates.exclusive_end(last)), "days_left": dates.days_left_in_month(last),
                      "month_before": dates.previous_period_start(last)})
    )


def look_back(ledger: DataFrame, as_of: str | dt.date, days: int) -> DataFrame:
    """Rows of the last `days` days up to as_of, never later ones."""
    anchor = dt.date.fromisoformat(str(as_of))
    first = anchor - dt.timedelta(days=days)
    return ledger.filter(F.col("posted_at").between(dates.as_date(first), dates.as_date(anchor)))


def last_periods(ledger: DataFrame, as_of: str | dt.date, count: int, period: str = "month") -> DataFrame:
    """Rows of the last `count` periods up to the one that holds as_of: what a report over them reads, cut before anything is typed."""
    day = F.lit(str(as_of)).cast("date")
    first = F.add_months(dates.period_start(day, period), -(count - 1) * dates.PERIOD_MONTHS[period])
    return ledger.filter(dates.in_range(F.col("posted_at"), first, dates.period_end(day, period)))


def search(
    ledger: DataFrame,
    accounts_dim: DataFrame,
    needle: str,
    as_of: str | dt.date,
    days: int = 90,
    selected: Sequence[str] | Column | None = None,
    limit: int = 200,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Newest rows of each ledger whose merchant or description holds the needle.

    `in_selection` splits hits on selected accounts from hits on others. Only
    the newest `limit` rows of a ledger are returned; hit_count and
    selected_count count all of its hits.
    """
    word = needle.lower()
    hit = F.contains(F.lower(F.coalesce("merchant", F.lit(""))), F.lit(word)) | F.contains(
        F.lower(F.coalesce("description", F.lit(""))), F.lit(word)
    )
    newest = Window.partitionBy(*keys).orderBy(F.desc("posted_at"), "fingerprint")
    names = accounts_dim.select("account_id", F.col("name").alias("account_name"))
    if selected is None:
        chosen = F.lit(True)
    else:
        chosen = selected if isinstance(selected, Column) else F.col("account_id").isin(list(selected))
    hits = with_merchant_norm(look_back(ledger, as_of, days).filter(hit)).withColumn("in_selection", chosen)
    counts = hits.groupBy(*keys).agg(F.count("*").alias("hit_count"), F.count_if("in_selection").alias("selected_count"))
    return (
        hits.withColumn("hit_rank", F.row_number().over(newest))
        .filter(F.col("hit_rank") <= limit)
        .join(counts, [*keys])
        .join(names, "account_id", "left")
    )


def search_summary(hits: DataFrame, keys: Sequence[str] = KEYS, limit: int = 200) -> DataFrame:
    """Counts of all search hits on selected and other accounts, and whether rows were left out."""
    return hits.groupBy(*keys).agg(
        F.first("selected_count").alias("selected_count"),
        F.first(F.col("hit_count") - F.col("selected_count")).alias("other_count"),
        (F.first("hit_count") > limit).alias("truncated"),
    )
