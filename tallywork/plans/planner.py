"""Spending-bucket plans, projections and cash-flow alerts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, money
from ..operators import classify as c
from ..operators.recurring import merchant_patterns, pattern_flags
from ..operators.scan import KEYS, for_accounts_or_all, posted_only, with_merchant_norm

BUCKETS = [c.FIXED, c.VARIABLE, c.DISCRETIONARY, c.ONE_OFFS]


def plan_window(as_of: str | dt.date, months: int) -> tuple[dt.date, dt.date]:
    """30-day months back from the first of the running month."""
    first = dt.date.fromisoformat(str(as_of)).replace(day=1)
    return first - dt.timedelta(days=30 * months), first


def bucketed_rows(
    ledger: DataFrame,
    as_of: str | dt.date,
    months: int = 6,
    accounts: Sequence[str] | None = None,
    type_overrides: DataFrame | None = None,
    merchant_rules: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Rows of the planning window typed with merchant patterns, so that every bucket can fill.

    Unlike the report, account kind, pairs and refunds play no part.
    """
    start, end = plan_window(as_of, months)
    patterns = merchant_patterns(ledger, as_of, months * 35, accounts, keys)
    rows = with_merchant_norm(
        for_accounts_or_all(ledger.filter(dates.in_range(F.col("posted_at"), start, end) & posted_only()), accounts))
    flagged = rows.join(pattern_flags(patterns, keys), [*keys, "merchant_norm"], "left")
    typed = c.classify(c.with_overrides(flagged, type_overrides, merchant_rules, keys))
    return typed.withColumn("month", F.trunc("posted_at", "month"))


def bucket_summary(bucketed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Monthly average, range, trend and predictability of each bucket that has spending."""
    scope = [*keys, "spending_bucket"]
    spent = bucketed.filter("spending_bucket is not null")
    monthly = spent.groupBy(*scope, "month").agg(F.sum(F.abs("amount_cents")).alias("cents"), F.count("*").alias("n"))
    newest = Window.partitionBy(*scope).orderBy(F.desc("month"))
    placed = monthly.withColumn("age", F.row_number().over(newest))
    recent, older = F.col("age") <= 2, F.col("age") > 2
    rows = placed.groupBy(*scope).agg(
        F.count("*").alias("months"), F.sum("cents").alias("total_cents"),
        F.bround(F.avg("cents")).cast("bigint").alias("monthly_avg_cents"),
        F.min("cents").alias("monthly_min_cents"), F.max("cents").alias("monthly_max_cents"),
        F.avg(F.when(recent, F.col("cents"))).alias("recent"), F.avg(F.when(older, F.col("cents"))).alias("older"),
        F.stddev_pop("cents").alias("spread"), F.avg("cents").alias("mean"), F.sum("n").alias("transaction_count"))
    merchants = spent.select(*scope, "merchant_norm").distinct().groupBy(*scope).agg(F.count("*").alias("merchant_count"))
    change = F.when((F.col("months") >= 3) & (F.col("older") > 0), (F.col("recent") - F.col("older")) / F.col("older") * 100)
    cv = F.when(F.col("mean") > 0, F.col("spread") / F.col("mean")).otherwise(F.lit(0.0))
    return (
        rows.join(merchants, scope)
        .withColumn("trend_percent", F.coalesce(change, F.lit(0.0)))
        .withColumn("trend", F.when(F.col("trend_percent") > 10, F.lit("increasing"))
                    .when(F.col("trend_percent") < -10, F.lit("decreasing")).otherwise(F.lit("stable")))
        .withColumn("predictability", F.when(F.col("months") > 1, F.greatest(F.lit(0.0), 1 - cv)).otherwise(F.lit(0.5)))
        .drop("recent", "older", "spread", "mean")
    )


def budget_plan(bucketed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Monthly income, spend per bucket, net, savings rate, health score and suggestions of each ledger."""
    income = bucketed.filter(F.col("txn_type") == c.INCOME).groupBy(*keys, "month").agg(F.sum("amount_cents").alias("cents"))
    income = income.groupBy(*keys).agg(money.floor_div(F.sum("cents"), F.count("*")).alias("income_cents"))
    buckets = bucket_summary(bucketed, keys)

    def of(bucket: str, column: str) -> Column:
        return F.max(F.when(F.col("spending_bucket") == bucket, F.col(column)))

    wide = buckets.groupBy(*keys).agg(
        *[F.coalesce(of(b, "monthly_avg_cents"), F.lit(0)).alias(f"{b.lower()}_cents") for b in BUCKETS],
        F.coalesce(of(c.FIXED, "predictability"), F.lit(0.0)).alias("fixed_predictability"),
        of(c.DISCRETIONARY, "trend").alias("discretionary_trend"),
        F.sum("monthly_avg_cents").alias("spend_cents"))
    plan = wide.join(income, list(keys), "full").na.fill(
        0, ["income_cents", "spend_cents", "fixed_predictability", *[f"{b.lower()}_cents" for b in BUCKETS]])
    net = F.col("income_cents") - F.col("spend_cents")
    rate = F.when(F.col("income_cents") > 0, net / F.col("income_cents") * 100).otherwise(F.lit(0.0))
    saving = (F.when(F.col("savings_rate") >= 20, F.lit(1.0)).when(F.col("savings_rate") >= 10, F.lit(0.7))
              .when(F.col("savings_rate") >= 0, F.lit(0.4)).otherwise(F.lit(0.1)))
    advice = F.array_compact(F.array(
        F.when(F.col("savings_rate") < 10, F.lit("low_savings_rate")),
        F.when(F.col("discretionary_trend") == "increasing", F.lit("discretionary_up")),
        F.when(F.col("one_offs_cents") > F.col("income_cents") * 0.2, F.lit("high_one_offs")),
        F.when(F.col("fixed_predictability") < 0.7, F.lit("fixed_varies"))))
    return (
        plan.withColumn("net_cents", net).withColumn("savings_rate", rate)
        .withColumn("health_score", (saving + F.col("fixed_predictability")) / 2)
        .withColumn("suggestions", advice)
    )


def bucket_merchants(bucketed: DataFrame, bucket: str, limit: int = 50, keys: Sequence[str] = KEYS) -> DataFrame:
    """Largest merchants of a bucket; the monthly figure is over all months the bucket has."""
    spent = bucketed.filter(F.col("spending_bucket") == bucket)
    months = spent.select(*keys, "month").distinct().groupBy(*keys).agg(F.count("*").alias("months"))
    merchants = spent.groupBy(*keys, "merchant_norm", "month").agg(
        F.sum(F.abs("amount_cents")).alias("cents"), F.count("*").alias("n")).groupBy(*keys, "merchant_norm").agg(
        F.sum("cents").alias("total_cents"), F.sum("n").alias("row_count"), F.count("*").alias("active_months"))
    order = Window.partitionBy(*keys).orderBy(F.desc("monthly_cents"), "merchant_norm")
    return (
        merchants.join(months, list(keys))
        .withColumn("monthly_cents", money.floor_div(F.col("total_cents"), F.col("months")))
        .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).drop("months")
    )


def bucket_months(bucketed: DataFrame, bucket: str, keys: Sequence[str] = KEYS) -> DataFrame:
    return bucketed.filter(F.col("spending_bucket") == bucket).groupBy(*keys, "month").agg(
        F.sum(F.abs("amount_cents")).alias("amount_cents"))


def budget_projection(plan: DataFrame, as_of: str | dt.date, months: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """The plan's monthly figures carried forward, one row per coming 30-day month."""
    first = F.trunc(dates.as_date(as_of), "month")
    steps = F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda i: F.date_format(F.date_add(first, i * 30), "yyyy-MM"))
    return plan.select(
        *keys, F.posexplode(steps).alias("step", "month"), F.col("income_cents").alias("projected_income_cents"),
        F.col("fixed_obligations_cents").alias("projected_fixed_cents"),
        F.col("variable_essentials_cents").alias("projected_variable_cents"),
        F.col("discretionary_cents").alias("projected_discretionary_cents"), F.col("net_cents").alias("projected_net_cents"))


# --- cash flow ----------------------------------------------------------------------

def upcoming_charges(
    board: DataFrame | None,
    subscriptions: DataFrame,
    bills: DataFrame,
    as_of: str | dt.date,
    days: int = 30,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Charges expected in the coming days with their confidence.

    Confirmed commitments come first; a merchant they cover is not predicted
    again from its history, even if it is not due in time.
    """
    today = dates.as_date(as_of)
    horizon = F.date_add(today, days)

    def guess(rows: DataFrame, cadence: Column, cents: Column, confidence: Column, source: str) -> DataFrame:
        return rows.select(
            *keys, F.lower("merchant_norm").alias("merchant_norm"),
            dates.next_charge(cadence, F.col("last_seen"), today).alias("expected_date"),
            cents.alias("amount_cents"), confidence.alias("confidence"), "cadence", F.lit(source).alias("source"))

    known = F.when(F.col("is_known_service"), F.lit(0.9)).otherwise(F.lit(0.7))
    guessed = guess(subscriptions, F.col("cadence"), F.col("charge_cents"), known, "subscription").unionByName(
        guess(bills, F.lit("monthly"), F.col("monthly_cents"), F.lit(0.6), "bill"))
    if board is not None:
        sure = board.filter("status = 'confirmed' and direction = 'expense' and resolved_cents is not null")
        covered = sure.filter("merchant_norm is not null and merchant_norm <> ''").select(
            *keys, F.lower("merchant_norm").alias("merchant_norm"))
        guessed = guessed.join(covered, [*keys, "merchant_norm"], "left_anti")
        guessed = sure.select(
            *keys, F.lower(F.coalesce(F.nullif(F.col("merchant_norm"), F.lit("")), F.col("name"))).alias("merchant_norm"),
            F.col("next_due").alias("expected_date"), F.col("resolved_cents").alias("amount_cents"),
            F.lit(1.0).alias("confidence"), "cadence", F.lit("commitment").alias("source")).unionByName(guessed)
    return guessed.filter(F.col("expected_date").between(today, horizon))


def income_estimate(
    reports: DataFrame, confirmed: DataFrame | None, days: int = 30, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Expected income: confirmed income per month, else the daily mean of the given reports."""
    length = F.sum(F.datediff("period_end", "period_start"))
    mean = reports.groupBy(*keys).agg((F.sum("income_cents") / length * days).cast("bigint").alias("expected_income_cents"))
    if confirmed is None:
        return mean
    sure = confirmed.filter("income_cents > 0").select(*keys, (F.col("income_cents") * days / 30).cast("bigint").alias("sure"))
    return mean.join(sure, list(keys), "full").select(*keys, F.coalesce("sure", "expected_income_cents").alias("expected_income_cents"))


def flexible_estimate(plan: DataFrame, days: int = 30, keys: Sequence[str] = KEYS) -> DataFrame:
    """Variable and discretionary spend for the coming days from a three-month plan."""
    scale = days / 30
    return plan.select(
        *keys, (F.col("variable_essentials_cents") * scale).cast("bigint").alias("expected_variable_cents"),
        (F.col("discretionary_cents") * scale).cast("bigint").alias("expected_discretionary_cents"))


def cash_flow(charges: DataFrame, income: DataFrame, flexible: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Expected income, fixed, variable, discretionary and net with the mean confidence of the charges."""
    fixed = charges.groupBy(*keys).agg(
        F.sum("amount_cents").alias("expected_fixed_cents"), F.avg("confidence").alias("confidence"))
    parts = ["expected_income_cents", "expected_fixed_cents", "expected_variable_cents", "expected_discretionary_cents"]
    flow = income.join(flexible, list(keys), "full").join(fixed, list(keys), "full").na.fill(0, parts).na.fill(0.5, ["confidence"])
    return flow.withColumn("expected_net_cents", F.col(parts[0]) - F.col(parts[1]) - F.col(parts[2]) - F.col(parts[3]))


def cash_flow_alerts(
    flow: DataFrame, charges: DataFrame, scores: DataFrame, as_of: str | dt.date, days: int = 30,
    min_confidence: float = 0.5, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Shortfalls, large charges and crowded days; a ledger of low integrity or confidence gets one notice instead."""
    today = dates.as_date(as_of)
    gated = flow.join(scores.select(*keys, "score", "is_actionable"), list(keys), "left").withColumn(
        "gate", F.when(~F.coalesce("is_actionable", F.lit(True)), F.lit("resolution_needed"))
        .when(F.col("confidence") < min_confidence, F.lit("low_confidence")))
    notice = gated.filter("gate is not null").select(
        *keys, F.col("gate").alias("alert_type"),
        F.when(F.col("gate") == "resolution_needed", F.lit("medium")).otherwise(F.lit("low")).alias("severity"),
        today.alias("alert_date"), F.lit(None).cast("bigint").alias("amount_cents"), F.lit(None).cast("string").alias("merchant_norm"))
    fit = gated.filter("gate is null")
    short = fit.filter("expected_net_cents < 0").select(
        *keys, F.lit("shortfall").alias("alert_type"),
        F.when(F.col("expected_net_cents") < -50000, F.lit("high")).otherwise(F.lit("medium")).alias("severity"),
        F.date_add(today, days).alias("alert_date"), F.col("expected_net_cents").alias("amount_cents"),
        F.lit(None).cast("string").alias("merchant_norm"))
    judged = charges.join(fit.select(*keys, "expected_income_cents"), list(keys))
    large = judged.filter("expected_income_cents > 0 and amount_cents * 100 / expected_income_cents > 20").select(
        *keys, F.lit("large_charge").alias("alert_type"), F.lit("medium").alias("severity"),
        F.col("expected_date").alias("alert_date"), "amount_cents", "merchant_norm")
    crowded = judged.groupBy(*keys, "expected_date").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("amount_cents")).filter(
        "n >= 3").select(*keys, F.lit("multiple_charges").alias("alert_type"), F.lit("low").alias("severity"),
                         F.col("expected_date").alias("alert_date"), "amount_cents", F.lit(None).cast("string").alias("merchant_norm"))
    return notice.unionByName(short).unionByName(large).unionByName(crowded)
