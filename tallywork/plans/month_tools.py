"""Roll-ups and the monthly survival report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators.containment import containing
from ..operators.scan import KEYS

# Least monthly saving worth a cut, and the watch marks that protect an item.
LEAST_CUT_USD = 5
PROTECTED = ["keep", "ignore", "done"]


def rollup(ledger: DataFrame, by: str = "day", keys: Sequence[str] = KEYS) -> DataFrame:
    """Net, outflow, inflow and row count by day, Monday week or month."""
    day = F.col("posted_at")
    period = {"day": day.cast("string"), "week": dates.monday_week_key(day), "month": F.date_format(day, "yyyy-MM")}[by]
    amount = F.col("amount_cents")
    return ledger.groupBy(*keys, period.alias("period")).agg(
        F.min("posted_at").alias("first_date"), F.sum("amount_cents").alias("net_cents"),
        F.sum(F.when(amount < 0, -amount).otherwise(F.lit(0))).alias("outflow_cents"),
        F.sum(F.when(amount > 0, amount).otherwise(F.lit(0))).alias("inflow_cents"), F.count("*").alias("row_count"))


def income_source(rows: DataFrame, income_rules: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds source_name: the first income rule of the ledger the merchant contains."""
    rules = income_rules.withColumn("lower_pattern", F.lower("pattern"))
    hits = containing(rows.select(*keys, "merchant_norm"), rules, "merchant_norm", "lower_pattern", keys)
    best = hits.join(rules, [*keys, "lower_pattern"]).groupBy(*keys, "merchant_norm").agg(F.min_by("name", "rule_order").alias("source_name"))
    return rows.join(best, [*keys, "merchant_norm"], "left")


def _dollars(cents: Column) -> Column:
    return F.round(cents / 100, 2)


def survival_report(
    ledger: DataFrame,
    income_rules: DataFrame,
    cut_items: DataFrame,
    month_start: str,
    top: int = 15,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One long table (section, rank, label, amount_usd) per ledger for a month.

    `cut_items` has label, impact_usd, decision and watch_status of what could be
    cancelled. Sections: summary, survival, cut_plan, top_spend_vendors,
    income_sources, income_quality.
    """
    start = dates.as_date(month_start)
    rows = ledger.filter(dates.in_range(F.col("posted_at"), start, F.add_months(start, 1))).withColumn(
        "label", text.raw_label(F.col("merchant"), F.col("description"))).filter("label is not null").withColumn(
        "merchant_norm", F.trim(F.lower("label")))
    credits = income_source(rows.filter("amount_cents > 0"), income_rules, keys)
    debits = rows.filter("amount_cents < 0")

    income = credits.groupBy(*keys).agg(
        F.sum("amount_cents").alias("income"), F.sum(F.when(F.col("source_name").isNotNull(), F.col("amount_cents"))).alias("matched"))
    spend = debits.groupBy(*keys).agg(F.sum(-F.col("amount_cents")).alias("spend"))
    sums = income.join(spend, list(keys), "full").na.fill(0, ["income", "matched", "spend"])
    share = F.try_divide(F.col("matched"), F.col("income"))
    sums = sums.withColumn("net", F.col("income") - F.col("spend")).withColumn(
        "confidence", F.when(share >= 0.8, F.lit("high")).when(F.col("matched") > 0, F.lit("medium")).otherwise(F.lit("low")))

    by_impact = Window.partitionBy(*keys).orderBy(F.desc("impact_usd"), "label")
    cuts = cut_items.filter(
        (F.col("impact_usd") >= LEAST_CUT_USD) & ~F.lower(F.coalesce("watch_status", F.lit(""))).isin(PROTECTED)
    ).withColumn("rank", F.row_number().over(by_impact) - 1).filter(F.col("rank") < top)
    saved = cuts.groupBy(*keys).agg(F.round(F.sum("impact_usd"), 2).alias("saved"))
    sums = sums.join(saved, list(keys), "left").withColumn("saved", F.coalesce("saved", F.lit(0.0)))

    def line(section: str, rank: int, label: str, usd: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(rank).alias("rank"), F.lit(label).alias("label"),
                        usd.cast("double").alias("amount_usd"))

    net = _dollars(F.col("net"))
    lines = [
        line("summary", 0, "income_total", _dollars(F.col("income"))),
        line("summary", 1, "spend_total", _dollars(F.col("spend"))),
        line("summary", 2, "net", net),
        line("survival", 0, "required_cuts_to_break_even", F.when(F.col("net") < 0, -net).otherwise(F.lit(0.0))),
        line("survival", 1, "cut_plan_savings", F.col("saved")),
        line("survival", 2, "net_after_cut_plan", F.round(net + F.col("saved"), 2)),
    ]
    quality = [line("income_quality", 0, "matched_income_total", _dollars(F.col("matched"))),
               line("income_quality", 1, "unknown_income_total", _dollars(F.col("income") - F.col("matched")))]
    head = sums.select(*keys, "confidence", F.inline(F.concat(
        F.array(*lines), F.when(F.col("income") > 0, F.array(*quality)).otherwise(F.array()))))

    def ranked(sections: DataFrame, section: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("cents"), "label")
        return sections.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < top).select(
            *keys, F.lit("").alias("confidence"), F.lit(section).alias("section"), "rank", "label", _dollars(F.col("cents")).alias("amount_usd"))

    vendors = debits.groupBy(*keys, "merchant_norm").agg(
        F.sum(-F.col("amount_cents")).alias("cents"), F.min("label").alias("label"))
    sources = credits.groupBy(*keys, F.coalesce("source_name", "merchant_norm").alias("source")).agg(
        F.sum("amount_cents").alias("cents"), F.min(F.coalesce("source_name", "label")).alias("label"))
    plan = cuts.select(*keys, F.lit("").alias("confidence"), F.lit("cut_plan").alias("section"), "rank", "label",
                       F.round("impact_usd", 2).alias("amount_usd"))
    return head.unionByName(plan).unionByName(ranked(vendors, "top_spend_vendors")).unionByName(ranked(sources, "income_sources"))
