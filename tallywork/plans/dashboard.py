"""Dashboard figures over period reports and category breakdowns.

Windows run over periods of one ledger, so they are as small as the number of periods.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, money
from ..operators.classify import with_service
from ..operators.detectors import with_alert_key
from ..operators.scan import KEYS, look_back, with_merchant_norm


def savings_history(reports: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Savings rate of each period with income."""
    return reports.filter("income_cents > 0").select(
        *keys, "period_start", "income_cents", "net_cents",
        F.bround(F.col("net_cents") / F.col("income_cents") * 100, 1).alias("savings_rate_pct"))


def insights(reports: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean savings rate, income stability and the run of positive months up to the newest."""
    history = savings_history(reports, keys)
    newest = Window.partitionBy(*keys).orderBy(F.desc("period_start"))
    misses = F.sum(F.when(F.col("net_cents") > 0, F.lit(0)).otherwise(F.lit(1))).over(newest)
    cv = F.coalesce(F.bround(F.stddev_pop("income_cents") / F.avg("income_cents") * 100, 1), F.lit(0.0))
    return history.withColumn("misses", misses).groupBy(*keys).agg(
        F.count("*").alias("months_with_data"),
        F.bround(F.avg("savings_rate_pct"), 1).alias("avg_savings_rate_pct"),
        cv.alias("income_cv"),
        F.count_if(F.col("misses") == 0).alias("savings_streak"),
    ).withColumn("income_stability", F.when(F.col("income_cv") >= 25, F.lit("variable"))
                 .when(F.col("income_cv") >= 10, F.lit("moderate")).otherwise(F.lit("stable")))


def prior_averages(view: DataFrame, months: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Average income, cash flow and savings rate of the periods before each period, where all of them exist."""
    order = Window.partitionBy(*keys).orderBy("period_start")
    before = order.rowsBetween(-months, -1)
    flow = F.col("income_cents") - F.col("recurring_cents") - F.col("discretionary_cents")
    rate = F.when(F.col("income_cents") > 0, F.col("net_cents") / F.col("income_cents") * 100)
    full = F.count("*").over(before) == months
    return view.select(
        *keys, "period_start",
        F.when(full, money.floor_div(F.sum("income_cents").over(before), months)).otherwise(F.lit(0)).alias("avg_income_cents"),
        F.when(full, money.floor_div(F.sum(flow).over(before), months)).otherwise(F.lit(0)).alias("avg_cash_flow_cents"),
        F.when(full, F.coalesce(F.bround(F.avg(rate).over(before), 1), F.lit(0.0))).otherwise(F.lit(0.0)).alias("avg_savings_rate_pct"))


def category_history(breakdown: DataFrame, as_of: str | dt.date, months: int = 4, keys: Sequence[str] = KEYS) -> DataFrame:
    """Net per category and month over the last months, zeros where a category has no rows."""
    scope = [*keys, "category"]
    first = F.add_months(F.trunc(dates.as_date(as_of), "month"), 1 - months)
    recent = breakdown.filter((F.col("period_start") >= first) & (F.col("period_start") <= dates.as_date(as_of)))
    spine = dates.with_periods(recent.select(*scope).distinct(), as_of, months)
    return spine.join(recent.select(*scope, "period_start", "net_cents"), [*scope, "period_start"], "left").na.fill(0, ["net_cents"])


def category_averages(breakdown: DataFrame, as_of: str | dt.date, months: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Current, previous and average net of each category; the average is over months that have the category."""
    scope = [*keys, "category"]
    this = F.trunc(dates.as_date(as_of), "month")
    now = F.col("period_start") == this
    past = (F.col("period_start") >= F.add_months(this, -months)) & (F.col("period_start") < this)
    net = F.col("net_cents")
    return breakdown.filter(now | past).groupBy(*scope).agg(
        F.sum(F.when(now, net)).alias("current_cents"),
        F.sum(F.when(F.col("period_start") == F.add_months(this, -1), net)).alias("previous_cents"),
        money.floor_div(F.sum(F.when(past, net)), F.count_if(past)).alias("avg_cents"),
    ).withColumn(
        "outlier_percent",
        F.when((F.col("avg_cents") > 0) & (F.col("current_cents") > F.col("avg_cents")),
               ((F.col("current_cents") - F.col("avg_cents")) * 100 / F.col("avg_cents")).cast("int")))


def top_movers(averages: DataFrame, least_cents: int = 3000, limit: int = 2, keys: Sequence[str] = KEYS) -> DataFrame:
    """Categories most above their average."""
    order = Window.partitionBy(*keys).orderBy(F.desc("delta_cents"), "category")
    moved = averages.filter("avg_cents > 0").withColumn("delta_cents", F.col("current_cents") - F.col("avg_cents"))
    return moved.filter(F.col("delta_cents") > least_cents).withColumn("place", F.row_number().over(order)).filter(
        F.col("place") <= limit)


def rising_categories(history: DataFrame, least: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Categories that rose month over month at least `least` times in a row up to the newest month."""
    scope = [*keys, "category"]
    order = Window.partitionBy(*scope).orderBy("period_start")
    newest = Window.partitionBy(*scope).orderBy(F.desc("period_start"))
    step = F.when(F.col("net_cents") > F.lag("net_cents").over(order), F.lit(0)).otherwise(F.lit(1))
    broken = history.withColumn("fell", step).withColumn("falls", F.sum("fell").over(newest))
    return broken.groupBy(*scope).agg(
        F.count_if(F.col("falls") == 0).alias("months_increasing"),
        F.max_by("net_cents", "period_start").alias("current_cents"),
        money.floor_div(F.sum("net_cents") - F.max_by("net_cents", "period_start"), F.count("*") - 1).alias("avg_cents"),
    ).filter(F.col("months_increasing") >= least)


def pace(view: DataFrame, as_of: str | dt.date, window: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Projected spend of the running month; no rows before its third day."""
    today = dates.as_date(as_of)
    order = Window.partitionBy(*keys).orderBy("period_start")
    spent = F.col("recurring_cents") + F.col("discretionary_cents")
    average = money.floor_div(F.sum(spent).over(order.rowsBetween(1 - window, 0)), F.count("*").over(order.rowsBetween(1 - window, 0)))
    share = F.dayofmonth(today) / F.dayofmonth(F.last_day(today))
    now = view.withColumn("avg_cents", average).filter(
        (F.col("period_start") == F.trunc(today, "month")) & (F.dayofmonth(today) >= 3))
    return now.select(
        *keys, spent.alias("spent_cents"), (spent / share).cast("bigint").alias("projected_cents"), "avg_cents",
    ).withColumn("variance_cents", F.col("projected_cents") - F.col("avg_cents")).withColumn(
        "variance_pct", F.when(F.col("avg_cents") > 0, F.bround(F.col("variance_cents") * 100 / F.col("avg_cents")).cast("int"))
        .otherwise(F.lit(0)))


def pace_drivers(averages: DataFrame, as_of: str | dt.date, limit: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Categories whose projected month is more than $20 over their average."""
    today = dates.as_date(as_of)
    share = F.dayofmonth(today) / F.dayofmonth(F.last_day(today))
    order = Window.partitionBy(*keys).orderBy(F.desc("variance_cents"), "category")
    rows = averages.filter((F.col("avg_cents") > 0) & F.col("current_cents").isNotNull() & (F.dayofmonth(today) >= 3))
    rows = rows.withColumn("projected_cents", (F.col("current_cents") / share).cast("bigint"))
    rows = rows.withColumn("variance_cents", F.col("projected_cents") - F.col("avg_cents")).filter("variance_cents > 2000")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def bill_deviations(classified: DataFrame, bills: DataFrame, as_of: str | dt.date, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bills whose newest charge this month is more than 15 % off the mean of the three months before."""
    merchant = [*keys, "merchant_norm"]
    this = F.trunc(dates.as_date(as_of), "month")
    rows = classified.filter(
        (F.col("txn_type") == "EXPENSE") & (F.col("posted_at") >= F.add_months(this, -3))
        & (F.col("posted_at") < F.add_months(this, 1))
    ).join(bills.select(*merchant).distinct(), merchant, "left_semi")
    now, size = F.col("posted_at") >= this, F.abs("amount_cents")
    order = F.struct("posted_at", "fingerprint")
    found = rows.groupBy(*merchant).agg(
        F.max_by(F.when(now, size), F.when(now, order)).alias("current_cents"),
        F.count_if(~now).alias("past_charges"),
        money.floor_div(F.sum(F.when(~now, size)), F.count_if(~now)).alias("avg_cents"))
    off = F.abs(F.col("current_cents") - F.col("avg_cents")) * 100 / F.col("avg_cents")
    return found.filter("current_cents is not null and past_charges >= 2 and avg_cents > 0").filter(off > 15).withColumn(
        "deviation_pct", off.cast("int"))


# Alert kinds that reach the attention feed.
ATTENTION_ALERTS = ["new_merchant", "unusual_amount", "suspicious_pattern"]


def attention_feed(
    alerts: DataFrame, rising: DataFrame, deviations: DataFrame, duplicates: DataFrame, limit: int = 4,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The few items a ledger should look at first: alerts, rising categories, bills off, duplicate services."""
    def item(rows: DataFrame, section: int, kind: str, key, rank, most: int | None) -> DataFrame:
        out = rows.select(*keys, F.lit(section).alias("section"), F.lit(kind).alias("item_type"), key.alias("item_key"),
                          rank.alias("item_rank"))
        if most is None:
            return out
        order = Window.partitionBy(*keys).orderBy("item_rank", "item_key")
        return out.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n")

    picked = with_alert_key(alerts.filter(F.col("pattern_type").isin(ATTENTION_ALERTS)))
    every = (
        item(picked, 1, "alert", F.col("alert_key"), -F.col("amount_cents").cast("bigint"), limit)
        .unionByName(item(rising, 2, "category_trend", F.concat(F.lit("trend_"), "category"), -F.col("current_cents"), 2))
        .unionByName(item(deviations, 3, "bill_deviation", F.concat(F.lit("bill_"), "merchant_norm"), -F.col("current_cents"), 2))
        .unionByName(item(duplicates.filter("severity = 'high'"), 4, "duplicate_sub",
                          F.concat(F.lit("dup_"), "group_name"), -F.col("total_monthly_cents"), limit))
    )
    order = Window.partitionBy(*keys).orderBy("section", "item_rank", "item_key")
    return every.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).drop("item_rank")


# --- payees ---------------------------------------------------------------------------

def payee_history(ledger: DataFrame, accounts_dim: DataFrame, payee: str, as_of: str | dt.date, days: int = 400) -> DataFrame:
    """Rows of a payee with where they came from and when they last changed."""
    rows = with_merchant_norm(look_back(ledger, as_of, days)).filter(F.col("merchant_norm") == payee.lower())
    names = accounts_dim.select("account_id", F.col("name").alias("account_name"))
    return rows.join(names, "account_id", "left").withColumns({
        "account_name": F.coalesce("account_name", "account_id", F.lit("Unknown")),
        "bank_merchant": F.coalesce("merchant", F.lit("")),
        "bank_description": F.coalesce("description", F.lit("")),
        "first_seen": F.to_date("created_at"),
        "last_updated": F.when(F.col("updated_at") > F.col("created_at"), F.to_date("updated_at")),
    })


def payee_totals(history: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    totals = history.groupBy(*keys, "merchant_norm").agg(
        F.count("*").alias("row_count"),
        F.sum(F.when(F.col("amount_cents") < 0, -F.col("amount_cents")).otherwise(F.lit(0))).alias("total_cents"))
    return with_service(totals).withColumns(
        {"is_known_service": F.col("service").isNotNull(), "display_name": F.col("service.display_name")}).drop("service")


def payee_pick(ledger: DataFrame, needle: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Payees that contain the needle, the most frequent first (place 1)."""
    rows = with_merchant_norm(ledger.filter("amount_cents < 0")).filter(
        F.contains("merchant_norm", F.lit(needle.strip().lower())) & (F.col("merchant_norm") != ""))
    stats = rows.groupBy(*keys, "merchant_norm").agg(
        F.count("*").alias("occurrences"), F.avg(F.abs("amount_cents")).cast("bigint").alias("avg_cents"),
        F.min("posted_at").alias("first_seen"), F.max("posted_at").alias("last_seen"))
    order = Window.partitionBy(*keys).orderBy(F.desc("occurrences"), F.desc("avg_cents"), "merchant_norm")
    return stats.withColumn("place", F.row_number().over(order))
