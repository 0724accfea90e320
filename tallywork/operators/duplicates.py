"""Duplicate and bundle groups of recurring merchants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money, text
from ..lexicon import keywords as kw
from ..session import cut_lineage
from .classify import first_family
from .scan import KEYS, look_back, with_merchant_norm
from .stats import day_gaps, exact_median


def group_members(patterns: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Members of every possible group: (keys, group_type, group_name, merchant_norm, monthly_cents, cadence)."""
    recurring = patterns.filter(F.col("is_recurring") & ~F.col("is_transfer"))
    m, cents, cadence = F.col("merchant_norm"), F.col("median_amount_cents"), F.col("cadence")
    fuzzy = recurring.select(
        *keys, F.lit("fuzzy_match").alias("group_type"), text.fuzzy_key(m).alias("group_name"), "merchant_norm",
        money.monthly_equivalent(cents, cadence).alias("monthly_cents"), "cadence",
    ).filter("group_name <> ''")
    names = F.array_compact(F.array(*[
        F.when(text.contains_any(m, words), F.lit(name)) for name, words in kw.DUPLICATE_FAMILIES.items()
    ]))
    families = recurring.select(
        *keys, F.lit("bundle_family").alias("group_type"), F.explode(names).alias("group_name"), "merchant_norm",
        money.bundle_monthly_equivalent(cents, cadence).alias("monthly_cents"), "cadence",
    )
    return fuzzy.unionByName(families)


def sized_members(members: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Members of groups of two or more, with the group's size and monthly cost."""
    group = [*keys, "group_type", "group_name"]
    sizes = members.groupBy(*group).agg(
        F.count("*").alias("member_count"), F.sum("monthly_cents").alias("total_monthly_cents")
    ).filter("member_count >= 2")
    return members.join(sizes, group)


def kept_members(members: DataFrame, dismissed: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Members of the groups that stay when, by falling cost, a group that shares a merchant with a kept one is dropped.

    A merchant is in one fuzzy group and in a handful of families, so a few rounds
    settle all groups: a group that comes first for all its merchants is kept, and
    the groups that share a merchant with it go.
    """
    group = [*keys, "group_type", "group_name"]
    merchant = [*keys, "merchant_norm"]
    members = sized_members(cut_lineage(members), keys)
    if dismissed is not None:
        banned = members.join(dismissed.select(*merchant), merchant).select(*group).distinct()
        members = members.join(banned, group, "left_anti")
    rank = F.struct(-F.col("total_monthly_cents"), F.col("group_type") == "bundle_family", F.col("group_name"))
    open_rows = cut_lineage(members.withColumn("rank", rank))
    kept: list[DataFrame] = []
    while not open_rows.isEmpty():
        first = F.min("rank").over(Window.partitionBy(*merchant))
        wins = F.bool_and(F.col("rank") == F.col("first")).over(Window.partitionBy(*group))
        judged = open_rows.withColumn("first", first).withColumn("wins", wins)
        taken = F.bool_or("wins").over(Window.partitionBy(*merchant))
        lost = F.bool_or(F.col("taken") & ~F.col("wins")).over(Window.partitionBy(*group))
        judged = cut_lineage(judged.withColumn("taken", taken).withColumn("lost", lost).drop("first", "taken"))
        kept.append(judged.filter("wins").drop("wins", "lost", "rank"))
        open_rows = judged.filter("not wins and not lost").drop("wins", "lost")
    result = kept[0] if kept else members
    for more in kept[1:]:
        result = result.unionByName(more)
    return result


def group_summary(kept: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per kept group with its first three merchants in the detail text."""
    group = [*keys, "group_type", "group_name"]
    by_name = Window.partitionBy(*group).orderBy("merchant_norm")
    top = (
        kept.withColumn("place", F.row_number().over(by_name)).filter("place <= 3").groupBy(*group)
        .agg(F.array_join(F.sort_array(F.collect_list("merchant_norm")), ", ").alias("first_names"),
             F.first("member_count").alias("member_count"), F.first("total_monthly_cents").alias("total_monthly_cents"))
    )
    bundle = F.col("group_type") == "bundle_family"
    return top.select(
        *group, "member_count", "total_monthly_cents",
        F.when(bundle, F.lit("medium")).otherwise(F.lit("high")).alias("severity"),
        F.when(bundle, F.concat("group_name", F.lit(": "), F.col("member_count").cast("string"),
                                F.lit(" overlapping services")))
        .otherwise(F.concat(F.lit("Similar merchant names: "), "first_names")).alias("detail"),
    )


def duplicate_groups(patterns: DataFrame, dismissed: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    return group_summary(kept_members(group_members(patterns, keys), dismissed, keys), keys)


# --- bundle check -------------------------------------------------------------

def _family_days(ledger: DataFrame, as_of: str, days: int, keys: Sequence[str]) -> DataFrame:
    """Outflows of the vendor families, counted by (label, day, amount)."""
    rows = with_merchant_norm(look_back(ledger, as_of, days).filter("amount_cents < 0")).filter("merchant_norm <> ''")
    return (
        rows.withColumn("family", first_family(F.col("merchant_norm"), kw.BUNDLE_FAMILIES))
        .filter("family is not null")
        .groupBy(*keys, "family", F.col("merchant_norm").alias("label"), "posted_at", F.abs("amount_cents").alias("cents"))
        .agg(F.count("*").alias("n"))
    )


def bundle_signals(
    ledger: DataFrame, as_of: str, days: int = 400, window_days: int = 3, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Families with two or more labels: labels, charges and pairs of different labels within the window.

    Pairs are counted, not listed: pairs of any labels minus pairs of the same
    label, each from a running count over days, so nothing grows with the square.
    """
    counted = _family_days(ledger, as_of, days, keys)
    family = [*keys, "family"]
    totals = counted.groupBy(*family).agg(F.sum("n").alias("charges"))
    labels = counted.select(*family, "label").distinct().groupBy(*family).agg(F.count("*").alias("labels"))

    def pairs(group: list[str]) -> DataFrame:
        per_day = counted.groupBy(*group, "posted_at").agg(F.sum("n").alias("n"))
        day_number = F.datediff("posted_at", F.lit("1970-01-01").cast("date")).cast("bigint")
        before = Window.partitionBy(*group).orderBy(day_number).rangeBetween(-window_days, -1)
        n = F.col("n")
        return per_day.withColumn(
            "pairs", n * F.coalesce(F.sum("n").over(before), F.lit(0)) + F.floor(n * (n - 1) / 2)
        ).groupBy(*family).agg(F.sum("pairs").cast("bigint").alias("pairs"))

    same = pairs([*family, "label"]).withColumnRenamed("pairs", "same_pairs")
    return (
        totals.join(labels.filter("labels >= 2"), family)
        .join(pairs(family), family).join(same, family)
        .select(*family, "labels", "charges", (F.col("pairs") - F.col("same_pairs")).alias("nearby_pairs"))
    )


def bundle_items(ledger: DataFrame, as_of: str, days: int = 400, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per label figures of families with two or more labels, and the likely main subscription."""
    counted = _family_days(ledger, as_of, days, keys)
    item = [*keys, "family", "label"]
    stats = counted.groupBy(*item).agg(
        F.sum("n").alias("charge_count"), F.min("posted_at").alias("first_date"), F.max("posted_at").alias("last_date"),
        F.min("cents").alias("min_cents"), F.max("cents").alias("max_cents"),
        F.percentile(F.dayofmonth("posted_at"), F.lit(0.5), F.col("n")).cast("int").alias("typical_bill_day"),
    )
    per_day = counted.groupBy(*item, "posted_at").agg(F.sum("n").alias("n"))
    gaps = day_gaps(per_day, item).filter("gap > 0").groupBy(*item).agg(
        F.percentile("gap", F.lit(0.5), F.col("n")).cast("int").alias("median_interval_days")
    )
    medians = exact_median(counted, item, "cents", "n", "median_cents").withColumn(
        "median_cents", F.col("median_cents").cast("bigint")
    )
    in_family = Window.partitionBy(*keys, "family")
    best = Window.partitionBy(*keys, "family").orderBy(F.desc("charge_count"), F.desc("last_date"), "label")
    return (
        stats.join(medians, item).join(gaps, item, "left")
        .withColumn("labels", F.count("*").over(in_family))
        .filter("labels >= 2")
        .withColumn("suggested_role", F.when(F.row_number().over(best) == 1, F.lit("primary_candidate"))
                    .otherwise(F.lit("component_candidate")))
        .drop("labels")
    )
