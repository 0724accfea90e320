"""Recurrence mining: merchant patterns, subscriptions, bills, price changes, duplicates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, text
from ..lexicon import keywords as kw
from .classify import is_noise, is_pattern_transfer, vendor_family, with_service
from .scan import KEYS, for_accounts_or_all, look_back, posted_only, with_merchant_norm
from .stats import day_gaps, exact_mad, exact_median

# Label of a median gap in days, both ends included.
CADENCE_BANDS = [
    ("weekly", 5, 10), ("biweekly", 12, 18), ("monthly", 25, 35),
    ("bimonthly", 55, 70), ("quarterly", 85, 100), ("annual", 330, 400),
]
# Cadences the canonical classifier takes for subscriptions.
SUBSCRIPTION_CADENCES = ["weekly", "monthly", "annual", "biweekly", "quarterly"]
# Strict candidates: name, lowest gap, highest gap, step, tolerance.
STRICT_CADENCES = [("weekly", 5, 9, 7, 2), ("monthly", 25, 35, 30, 5), ("annual", 330, 400, 365, 20)]


def band_label(gap: Column) -> Column:
    chain = F
    for name, low, high in CADENCE_BANDS:
        chain = chain.when(gap.between(low, high), F.lit(name))
    return chain


def _daily(rows: DataFrame, group: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows counted by day, and by amount, from one shared count by (day, amount)."""
    counted = rows.groupBy(*group, "posted_at", "cents").agg(F.count("*").alias("n"))
    days = counted.groupBy(*group, "posted_at").agg(
        F.sum("n").alias("n"),
        F.min("cents").alias("low"),
        F.max("cents").alias("high"),
        F.sum(F.col("n") * F.col("cents")).cast("decimal(38,0)").alias("total"),
        F.sum(F.col("n").cast("decimal(19,0)") * (F.col("cents").cast("decimal(19,0)") * F.col("cents").cast("decimal(19,0)")))
        .cast("decimal(38,0)").alias("squares"),
    )
    amounts = counted.groupBy(*group, "cents").agg(F.sum("n").alias("n"))
    return days, amounts


def _day_summary(days: DataFrame, group: Sequence[str]) -> DataFrame:
    """Count, dates, range and sample variation of the amounts; sums are exact decimals."""
    n, total, squares = F.sum("n"), F.sum("total").cast("decimal(38,0)"), F.sum("squares").cast("decimal(38,0)")
    spread = n.cast("double") * squares.cast("double") - total.cast("double") * total.cast("double")
    mean = total.cast("double") / n
    return days.groupBy(*group).agg(
        n.alias("occurrence_count"),
        F.min("posted_at").alias("first_seen"),
        F.max("posted_at").alias("last_seen"),
        F.min("low").alias("amount_min_cents"),
        F.max("high").alias("amount_max_cents"),
        F.when((n >= 2) & (mean > 0), F.sqrt(F.greatest(spread, F.lit(0.0)) / (n.cast("double") * (n - 1))) / mean)
        .otherwise(F.lit(0.0)).alias("amount_cv"),
    )


def merchant_patterns(
    ledger: DataFrame,
    as_of: str | dt.date,
    days: int = 400,
    accounts: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One row per (keys, merchant_norm) of posted outflows in the look-back window."""
    group = [*keys, "merchant_norm"]
    rows = with_merchant_norm(
        for_accounts_or_all(look_back(ledger, as_of, days), accounts).filter((F.col("amount_cents") < 0) & posted_only())
    ).filter("merchant_norm <> ''").select(*group, "posted_at", F.abs("amount_cents").alias("cents"))
    by_day, by_amount = _daily(rows, group)

    gaps = day_gaps(by_day.select(*group, "posted_at", "n"), group)
    gap_median = gaps.groupBy(*group).agg(F.percentile("gap", F.lit(0.5), F.col("n")).cast("int").alias("median_gap"))
    spread = (
        gaps.join(gap_median, group)
        .withColumn("distance", F.abs(F.col("gap") - F.col("median_gap")))
        .groupBy(*group, "median_gap")
        .agg(F.percentile("distance", F.lit(0.5), F.col("n")).alias("gap_mad"))
    )
    medians = exact_median(by_amount, group, "cents", "n", "median_amount")

    gap, mad = F.col("median_interval_days"), F.col("gap_mad")
    steady = F.coalesce((mad <= F.greatest(F.lit(7.0), gap * 0.3)) & gap.between(5, 400), F.lit(False))
    return (
        _day_summary(by_day, group)
        .join(medians, group)
        .join(spread, group, "left")
        .withColumn("median_amount_cents", F.col("median_amount").cast("bigint"))
        .withColumn("median_interval_days", F.when(F.col("occurrence_count") >= 3, F.col("median_gap")))
        .withColumn("is_recurring", steady)
        .withColumn("is_habitual", ~F.col("is_recurring") & (F.col("occurrence_count") >= 6))
        .withColumn("is_transfer", is_pattern_transfer(F.col("merchant_norm")))
        .withColumn("cadence", F.when(F.col("is_recurring"), F.coalesce(band_label(gap), F.lit("regular")))
                    .when(F.col("is_habitual"), F.lit("habitual")).otherwise(F.lit("")))
        .drop("median_amount", "median_gap", "gap_mad")
    )


def pattern_flags(patterns: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The flags the classifiers read, keyed by merchant."""
    return patterns.select(
        *keys, "merchant_norm",
        F.col("is_transfer").alias("pattern_transfer"),
        F.col("is_recurring").alias("pattern_recurring"),
        (F.col("is_recurring") & F.col("cadence").isin(SUBSCRIPTION_CADENCES)).alias("pattern_subscription"),
        F.col("is_habitual").alias("pattern_habitual"),
        F.col("cadence").alias("pattern_cadence"),
    )


def with_pattern_class(patterns: DataFrame) -> DataFrame:
    """Adds pattern_class and class_confidence: word rules first, then cadence and amounts."""
    m, cadence, cv = F.col("merchant_norm"), F.col("cadence"), F.col("amount_cv")
    cents, n, recurring = F.col("median_amount_cents"), F.col("occurrence_count"), F.col("is_recurring")

    def has(words):
        return text.contains_any(m, words)

    large_steady_month = (cadence == "monthly") & (cents >= 50000) & (cv < 0.10)
    fixed_price = recurring & cadence.isin("weekly", "monthly", "quarterly", "annual", "bimonthly") & (cv < 0.05) & (cents < 30000)
    periodic = recurring & cadence.isin("monthly", "quarterly", "annual") & (cents >= 5000)
    rules = [
        (n < 2, "uncategorized", 0.3),
        (F.col("is_transfer"), "transfer", 0.9),
        (has(kw.UTILITY) & cadence.isin("monthly", "bimonthly") & (n >= 3), "utility", 0.95),
        (has(kw.DEBT) & (cadence == "monthly") & (cents >= 10000), "debt_payment", 0.95),
        (has(kw.INSURANCE) & recurring & (cents >= 5000), "insurance", 0.95),
        (has(kw.SUBSCRIPTION) & recurring & (cents < 50000), "subscription", 0.95),
        (large_steady_month & has(kw.FINANCE), "debt_payment", 0.90),
        (large_steady_month & (cents >= 100000), "debt_payment", 0.75),
        (fixed_price & has(kw.STABLE_SUBSCRIPTION), "subscription", 0.95),
        (fixed_price, "subscription", 0.80),
        ((cadence == "monthly") & (n >= 3) & (cv >= 0.05) & cents.between(3000, 100000), "utility", 0.75),
        (periodic & has(kw.INSURANCE_OR_PREMIUM), "insurance", 0.95),
        (periodic & (cv < 0.1) & (cents >= 20000), "insurance", 0.60),
        (F.col("is_habitual"), "habitual", 0.80),
    ]
    chain = F
    for condition, name, confidence in rules:
        chain = chain.when(condition, F.struct(F.lit(name).alias("name"), F.lit(confidence).alias("confidence")))
    chain = chain.otherwise(F.struct(F.lit("uncategorized").alias("name"), F.lit(0.3).alias("confidence")))
    return (
        patterns.withColumn("class", chain)
        .withColumn("pattern_class", F.col("class.name"))
        .withColumn("class_confidence", F.col("class.confidence"))
        .drop("class")
    )


def _with_type_override(rows: DataFrame, overrides: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """override_type bill / subscription / ignore of the user for a merchant."""
    if overrides is None:
        return rows.withColumn("override_type", F.lit(None).cast("string"))
    return rows.join(overrides.select(*keys, "merchant_norm", "override_type"), [*keys, "merchant_norm"], "left")


SUBSCRIPTION_COLUMNS = [
    "merchant_norm", "monthly_cents", "cadence", "first_seen", "last_seen", "is_duplicate",
    "is_known_service", "display_name", "charge_cents",
]


def subscriptions(
    ledger: DataFrame,
    as_of: str | dt.date,
    days: int = 400,
    patterns: DataFrame | None = None,
    duplicate_members: DataFrame | None = None,
    type_overrides: DataFrame | None = None,
    accounts: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Recurring subscriptions, then known services seen too rarely for a pattern."""
    group = [*keys, "merchant_norm"]
    patterns = merchant_patterns(ledger, as_of, days, accounts, keys) if patterns is None else patterns
    recurring = with_service(_with_type_override(
        with_pattern_class(patterns.filter(F.col("is_recurring") & ~F.col("is_transfer"))), type_overrides, keys
    ))
    override = F.coalesce("override_type", F.lit(""))
    listed = recurring.filter(~override.isin("bill", "ignore")).filter(
        (override == "subscription") | F.col("service").isNotNull() | (F.col("pattern_class") == "subscription")
    )
    first = listed.select(
        *group,
        money.monthly_equivalent(F.col("median_amount_cents"), F.col("cadence")).alias("monthly_cents"),
        "cadence", "first_seen", "last_seen",
        F.col("service").isNotNull().alias("is_known_service"),
        F.col("service.display_name").alias("display_name"),
        F.col("median_amount_cents").alias("charge_cents"),
    )

    outflows = with_merchant_norm(
        for_accounts_or_all(look_back(ledger, as_of, days), accounts).filter("amount_cents < 0")
    ).select(*group, "posted_at", F.abs("amount_cents").alias("cents"))
    seen = with_service(outflows.groupBy(*group, "cents").agg(
        F.count("*").alias("n"), F.min("posted_at").alias("first_seen"), F.max("posted_at").alias("last_seen")
    )).filter(F.col("service").isNotNull() & ~is_pattern_transfer(F.col("merchant_norm")))
    rest = seen.join(first.select(*group), group, "left_anti")
    history = rest.groupBy(*group, "service").agg(
        F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    ).join(exact_median(rest, group, "cents", "n", "median_amount"), group)
    history = _with_type_override(history, type_overrides, keys).filter(
        ~F.coalesce("override_type", F.lit("")).isin("bill", "ignore")
    )
    cents = F.col("median_amount").cast("bigint")
    quiet = F.datediff(F.lit(str(as_of)).cast("date"), "last_seen") >= 45
    interval = F.datediff("last_seen", "first_seen")
    cadence = (
        F.when((F.col("n") <= 2) & quiet & (cents >= 4000), F.lit("annual"))
        .when((F.col("n") == 2) & (interval >= 300), F.lit("annual"))
        .when((F.col("n") == 2) & (interval >= 80), F.lit("quarterly"))
        .otherwise(F.col("service.service_cadence"))
    )
    cadence = F.when(cadence.isin("annual", "quarterly"), cadence).otherwise(F.lit("monthly"))
    second = history.withColumn("cadence", cadence).select(
        *group,
        money.bundle_monthly_equivalent(cents, F.col("cadence")).alias("monthly_cents"),
        "cadence", "first_seen", "last_seen", F.lit(True).alias("is_known_service"),
        F.col("service.display_name").alias("display_name"), cents.alias("charge_cents"),
    )
    both = first.unionByName(second)
    if duplicate_members is None:
        both = both.withColumn("is_duplicate", F.lit(False))
    else:
        members = duplicate_members.select(*group).distinct().withColumn("is_duplicate", F.lit(True))
        both = both.join(members, group, "left").withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))
    return both.select(*keys, *SUBSCRIPTION_COLUMNS)


def bills(patterns: DataFrame, type_overrides: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Recurring merchants that look like utilities or insurance."""
    rows = _with_type_override(
        with_pattern_class(patterns.filter(F.col("is_recurring") & ~F.col("is_transfer"))), type_overrides, keys
    )
    override = F.coalesce("override_type", F.lit(""))
    return rows.filter(~override.isin("subscription", "ignore")).filter(
        (override == "bill") | F.col("pattern_class").isin("utility", "insurance")
    ).select(
        *keys, "merchant_norm",
        money.monthly_equivalent(F.col("median_amount_cents"), F.col("cadence")).alias("monthly_cents"),
        "cadence", "first_seen", "last_seen",
        F.when(override == "bill", F.lit("utility")).otherwise(F.col("pattern_class")).alias("bill_type"),
    )


def price_changes(
    ledger: DataFrame,
    as_of: str | dt.date,
    days: int = 180,
    min_change: float = 10.0,
    max_change: float = 100.0,
    accounts: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Merchants whose newest charge left the usual amount of all but the last two.

    Equal charges of one day are counted together. Days per merchant are bounded
    by the look-back, so the windows run over (day, amount) groups.
    """
    group = [*keys, "merchant_norm"]
    rows = with_merchant_norm(
        for_accounts_or_all(look_back(ledger, as_of, days), accounts).filter("amount_cents < 0")
    ).filter("merchant_norm <> ''")
    runs = rows.groupBy(*group, "posted_at", F.abs("amount_cents").alias("cents")).agg(F.count("*").alias("n"))
    newest = Window.partitionBy(*group).orderBy(F.desc("posted_at"), F.desc("cents"))
    placed = (
        runs.withColumn("after", F.sum("n").over(newest) - F.col("n"))
        .withColumn("older_n", F.greatest(F.col("n") - F.greatest(F.lit(2) - F.col("after"), F.lit(0)), F.lit(0)))
        .withColumn("previous_cents", F.lead("cents").over(newest))
    )
    usual = (
        placed.filter("older_n > 0").groupBy(*group, "cents")
        .agg(F.sum("older_n").alias("mode_n"))
        .groupBy(*group)
        .agg(F.max(F.struct("mode_n", "cents")).alias("mode"), F.sum("mode_n").alias("older_total"))
    )
    last = placed.groupBy(*group).agg(F.max_by("cents", -F.col("after")).alias("new_cents"), F.sum("n").alias("charges"))
    change = (F.col("new_cents") - F.col("old_cents")) / F.col("old_cents") * 100
    found = (
        usual.join(last, group)
        .filter((F.col("charges") >= 4) & (F.col("mode.mode_n") / F.col("older_total") >= 0.6))
        .withColumn("old_cents", F.col("mode.cents"))
        .filter((F.col("old_cents") > 0) & F.abs(change).between(min_change, max_change))
        .select(*group, "old_cents", "new_cents", change.alias("change_pct"))
    )
    moved = (
        placed.join(found.select(*group, "old_cents", "new_cents"), group)
        .filter((F.col("cents") == F.col("new_cents"))
                & (F.col("previous_cents").isNull() | (F.col("previous_cents") == F.col("old_cents"))))
        .groupBy(*group).agg(F.min("posted_at").alias("change_date"))
    )
    return with_service(found.join(moved, group, "left")).withColumn("display_name", F.col("service.display_name")).drop("service")


def strict_candidates(
    ledger: DataFrame,
    as_of: str | dt.date,
    days: int = 400,
    raw_labels: bool = False,
    accounts: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Subscription candidates with clean gaps and steady amounts.

    The default is the export list: outflows up to $300 by normalised label,
    without noise. With raw_labels it is the report list: all signs, labels as
    written, other weights.
    """
    group = [*keys, "label"]
    rows = with_merchant_norm(for_accounts_or_all(look_back(ledger, as_of, days), accounts))
    if raw_labels:
        rows = rows.withColumn("label", text.raw_label(F.col("merchant"), F.col("description"))).filter("label is not null")
    else:
        rows = rows.filter("amount_cents between -30000 and -1").withColumn("label", F.col("merchant_norm"))
        rows = rows.filter((F.col("label") != "") & ~is_noise(F.col("label")))
    counted = rows.select(*group, "posted_at", F.abs("amount_cents").alias("cents"))
    by_day, by_amount = _daily(counted, group)
    gaps = day_gaps(by_day.select(*group, "posted_at", "n"), group)
    gap_stats = gaps.groupBy(*group).agg(
        F.percentile("gap", F.lit(0.5), F.col("n")).alias("gap_median"),
        F.sum("n").alias("gaps"),
        F.sum(F.col("gap") * F.col("n")).alias("gap_total"),
        *[F.sum(F.when(F.abs(F.col("gap") - step) <= tol, F.col("n")).otherwise(F.lit(0))).alias(f"fit_{name}")
          for name, _, _, step, tol in STRICT_CADENCES],
    )
    pick = F
    for name, low, high, step, tol in STRICT_CADENCES:
        pick = pick.when(F.col("gap_median").between(low, high), F.struct(
            F.lit(name).alias("cadence"), F.lit(step).alias("step"), F.lit(tol).alias("tol"),
            (F.col(f"fit_{name}") / F.col("gaps")).alias("fit")))
    fits = gap_stats.withColumn("fit", pick).filter("fit is not null and gaps >= 2 and fit.fit >= 0.66").select(
        *group, "fit.*", "gaps", F.bround(F.col("gap_total") / F.col("gaps")).cast("int").alias("avg_delta_days")
    )
    medians = exact_median(by_amount, group, "cents", "n", "amount_median")
    mads = exact_mad(by_amount.join(medians, group), group, "cents", "n", "amount_median", "amount_mad")
    cents = F.col("amount_median").cast("bigint")
    today = F.lit(str(as_of)).cast("date")
    weights = (0.5, 0.3, 0.2) if raw_labels else (0.55, 0.35, 0.10)
    recent = F.when(F.datediff(today, "last_seen") <= F.col("step") + F.col("tol"), F.lit(weights[2])).otherwise(F.lit(0.0))
    family = vendor_family(F.col("label"))
    suffix = "" if raw_labels else "-ish"
    return (
        fits.join(medians, group).join(mads, group).join(_day_summary(by_day, group), group)
        .filter(F.col("amount_mad") <= F.greatest(F.lit(200), F.floor(cents * 0.05)))
        .select(
            *group,
            family["family"].alias("family"), family["subtype"].alias("subtype"),
            F.col("occurrence_count").alias("occurrences"),
            F.concat("cadence", F.lit(suffix)).alias("cadence_guess"),
            F.when(F.col("step") == 365, F.bround(cents / 12).cast("bigint"))
            .when(F.col("step") == 30, cents).otherwise(F.bround(cents * 4.33).cast("bigint")).alias("monthly_est_cents"),
            cents.alias("amount_median_cents"), F.col("amount_mad").cast("bigint").alias("amount_mad_cents"),
            "avg_delta_days",
            F.round(F.col("fit") * weights[0] + weights[1] + recent, 3).alias("confidence"),
            "first_seen", "last_seen", F.date_add("last_seen", F.col("step")).alias("next_expected"),
        )
    )
