"""The period report: classify every row, then add up by ledger and period."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, labels, money, text
from ..lexicon.categories import NOT_SPENDING
from ..operators import classify as c
from ..operators.pairing import pair_legs, visible_pairs
from ..operators.recurring import pattern_flags
from ..operators.scan import KEYS, for_accounts, posted_only, with_merchant_norm

CLASSIFIER_VERSION = REPORT_VERSION = "1.0.0"
TOTALS = [
    "income_cents", "fixed_obligations_cents", "variable_essentials_cents", "discretionary_cents", "one_offs_cents",
    "refunds_cents", "credits_other_cents", "transfers_in_cents", "transfers_out_cents",
]


def classified_ledger(
    ledger: DataFrame,
    accounts_dim: DataFrame,
    pairs: DataFrame | None = None,
    refunds: DataFrame | None = None,
    patterns: DataFrame | None = None,
    type_overrides: DataFrame | None = None,
    merchant_rules: DataFrame | None = None,
    category_overrides: DataFrame | None = None,
    texts: DataFrame | None = None,
    accounts: Sequence[str] | DataFrame | None = None,
    include_pending: bool = False,
    with_categories: bool = True,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The ledger with type, bucket, category, reason and transfer status of every row.

    With `accounts`, only their rows, and only pairs of which both legs are among them.

    Pairs and refunds are optional inputs. With patterns, subscriptions become
    fixed obligations and habitual merchants variable essentials; without, all
    spending is discretionary. `texts` is the stored table of category_texts.
    """
    rows = ledger if include_pending else ledger.filter(posted_only())
    rows = c.with_card_flag(with_merchant_norm(for_accounts(rows, accounts)), accounts_dim, c.reads_card_flag())
    if pairs is not None:
        legs = pair_legs(visible_pairs(pairs, accounts), keys).select(*keys, "fingerprint", "pair_id", F.lit(True).alias("is_paired"))
        rows = rows.join(legs, [*keys, "fingerprint"], "left")
    if refunds is not None:
        paid = refunds.select(*keys, F.col("refund_fingerprint").alias("fingerprint"), F.col("expense_fingerprint").alias("refund_of"))
        rows = rows.join(paid, [*keys, "fingerprint"], "left")
    rows = c.with_overrides(rows, type_overrides, merchant_rules, keys)
    if patterns is not None:
        rows = rows.join(pattern_flags(patterns, keys), [*keys, "merchant_norm"], "left")
    rows = c.classify(rows)
    if with_categories:
        rows = c.with_category(rows, category_overrides, texts, keys)
    paired = F.coalesce(F.col("is_paired"), F.lit(False)) if pairs is not None else F.lit(False)
    return rows.withColumn(
        "transfer_status",
        F.when(paired, F.lit("MATCHED")).when(F.col("txn_type") == c.TRANSFER, F.lit("UNMATCHED")))


def _sum_when(condition: Column, value: Column, name: str) -> Column:
    return F.sum(F.when(condition, value).otherwise(F.lit(0))).cast("bigint").alias(name)


def total_columns() -> list[Column]:
    kind, bucket, amount = F.col("txn_type"), F.col("spending_bucket"), F.col("amount_cents")
    size, expense = F.abs(amount), kind == c.EXPENSE
    known = F.coalesce(bucket.isin(c.FIXED, c.VARIABLE, c.ONE_OFFS), F.lit(False))
    return [
        _sum_when(kind == c.INCOME, amount, "income_cents"),
        _sum_when(expense & (bucket == c.FIXED), size, "fixed_obligations_cents"),
        _sum_when(expense & (bucket == c.VARIABLE), size, "variable_essentials_cents"),
        _sum_when(expense & ~known, size, "discretionary_cents"),
        _sum_when(expense & (bucket == c.ONE_OFFS), size, "one_offs_cents"),
        _sum_when(kind == c.REFUND, amount, "refunds_cents"),
        _sum_when(kind == c.CREDIT_OTHER, amount, "credits_other_cents"),
        _sum_when((kind == c.TRANSFER) & (amount > 0), amount, "transfers_in_cents"),
        _sum_when((kind == c.TRANSFER) & (amount <= 0), size, "transfers_out_cents"),
        F.count("*").alias("transaction_count"),
        F.count_if(kind == c.CREDIT_OTHER).alias("unclassified_credit_count"),
        _sum_when(kind == c.CREDIT_OTHER, amount, "unclassified_credit_cents"),
    ]


def with_derived(totals: DataFrame) -> DataFrame:
    spent = sum((F.col(n) for n in TOTALS[2:5]), F.col("fixed_obligations_cents"))
    return totals.withColumn("total_expenses_cents", spent).withColumns({
        "net_spend_cents": F.col("total_expenses_cents") - F.col("refunds_cents"),
        "net_cents": F.col("income_cents") + F.col("refunds_cents") - F.col("total_expenses_cents"),
        "transfer_balance_cents": F.col("transfers_in_cents") - F.col("transfers_out_cents"),
    })


def period_totals(classified: DataFrame, period: str = "month", keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per ledger and period with the nine totals and what derives from them."""
    rows = classified.withColumn("period_start", dates.period_start(F.col("posted_at"), period))
    return with_derived(rows.groupBy(*keys, "period_start").agg(*total_columns()))


def range_totals(classified: DataFrame, start: str, end: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Totals of one custom range [start, end)."""
    rows = classified.filter(dates.in_range(F.col("posted_at"), start, end))
    return with_derived(rows.groupBy(*keys).agg(*total_columns()))


def period_reports(
    totals: DataFrame, ledgers: DataFrame, as_of: str | dt.date, count: int, period: str = "month", keys: Sequence[str] = KEYS
) -> DataFrame:
    """The last `count` periods of every ledger; periods without rows are there with zeros."""
    spine = dates.with_periods(ledgers.select(*keys).distinct(), as_of, count, period)
    figures = [n for n in totals.columns if n not in (*keys, "period_start")]
    joined = spine.join(totals, [*keys, "period_start"], "left").na.fill(0, figures)
    return joined.withColumn("period_end", dates.period_end(F.col("period_start"), period)).withColumn(
        "period_label", dates.period_label(F.col("period_start"), period))


def pending_counts(
    ledger: DataFrame, period: str = "month", accounts: Sequence[str] | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    rows = for_accounts(ledger, accounts).withColumn("period_start", dates.period_start(F.col("posted_at"), period))
    return rows.groupBy(*keys, "period_start").agg(
        F.count_if(F.coalesce("pending", F.lit(False))).alias("pending_count")).filter("pending_count > 0")


# --- views over reports -------------------------------------------------------

def period_view(reports: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Recurring, discretionary, credit and transfer figures of each report."""
    flexible = F.col("variable_essentials_cents") + F.col("discretionary_cents") + F.col("one_offs_cents")
    return reports.select(
        *keys, "period_start", "income_cents",
        (F.col("refunds_cents") + F.col("credits_other_cents")).alias("credit_cents"),
        F.col("fixed_obligations_cents").alias("recurring_cents"),
        flexible.alias("discretionary_cents"),
        (F.col("transfers_in_cents") + F.col("transfers_out_cents")).alias("transfer_cents"),
        F.col("transfers_in_cents").alias("incoming_transfer_cents"),
        "net_cents", "transaction_count",
    )


def period_trends(
    view: DataFrame, window: int = 3, confirmed: DataFrame | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Rolling averages, previous values and trend labels.

    `confirmed` (keys, income_cents, expense_cents) replaces an average where its
    sum is above zero.
    """
    order = Window.partitionBy(*keys).orderBy("period_start")
    recent = order.rowsBetween(1 - window, 0)
    out = view
    for name in ("income", "recurring", "discretionary"):
        col = F.col(f"{name}_cents")
        out = out.withColumn(f"avg_{name}_cents", money.floor_div(F.sum(col).over(recent), F.count("*").over(recent)))
        out = out.withColumn(f"prev_{name}_cents", F.lag(col).over(order))
        out = out.withColumn(f"{name}_trend", F.when(F.col(f"prev_{name}_cents").isNull(), F.lit("stable")).otherwise(
            labels.trend(col, F.col(f"prev_{name}_cents"))))
    if confirmed is None:
        return out
    sums = confirmed.select(*keys, F.col("income_cents").alias("sure_income"), F.col("expense_cents").alias("sure_expense"))
    return (
        out.join(sums, list(keys), "left")
        .withColumn("avg_income_cents", F.when(F.col("sure_income") > 0, F.col("sure_income")).otherwise(F.col("avg_income_cents")))
        .withColumn("avg_recurring_cents", F.when(F.col("sure_expense") > 0, F.col("sure_expense")).otherwise(F.col("avg_recurring_cents")))
        .drop("sure_income", "sure_expense")
    )


def merchant_summary(classified: DataFrame, period: str = "month", keys: Sequence[str] = KEYS) -> DataFrame:
    """Totals by section and merchant: income, recurring, one-off, transfer, credit."""
    kind = F.col("txn_type")
    section = (
        F.when(kind == c.INCOME, F.lit("income")).when(kind == c.TRANSFER, F.lit("transfer"))
        .when(kind.isin(c.REFUND, c.CREDIT_OTHER), F.lit("credit"))
        .when(F.col("spending_bucket") == c.FIXED, F.lit("recurring")).otherwise(F.lit("one_off"))
    )
    merchant = F.when(F.col("merchant_norm") == "", F.lit("Unknown")).otherwise(F.col("merchant_norm"))
    amount = F.when(section.isin("income", "credit"), F.col("amount_cents")).otherwise(F.abs("amount_cents"))
    return classified.groupBy(
        *keys, dates.period_start(F.col("posted_at"), period).alias("period_start"), section.alias("section"),
        merchant.alias("merchant"),
    ).agg(F.sum(amount).alias("total_cents"), F.count("*").alias("row_count"))


def month_summary(totals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Baseline, net and verdict of each month."""
    one_off = F.col("variable_essentials_cents") + F.col("discretionary_cents") + F.col("one_offs_cents")
    return totals.select(
        *keys, "period_start", "income_cents", F.col("fixed_obligations_cents").alias("recurring_cents"),
        one_off.alias("one_off_cents"), (F.col("transfers_in_cents") + F.col("transfers_out_cents")).alias("transfer_cents"),
    ).withColumn("baseline_cents", F.col("income_cents") - F.col("recurring_cents")).withColumn(
        "net_cents", F.col("baseline_cents") - F.col("one_off_cents")).withColumn(
        "verdict", labels.verdict(F.col("baseline_cents"), F.col("net_cents")))


# --- the five-label analysis ----------------------------------------------------

def five_label_periods(labelled: DataFrame, period: str = "month", keys: Sequence[str] = KEYS) -> DataFrame:
    """Sums by the five labels with ratios, health and the checksum over all rows."""
    label, amount, size = F.col("label"), F.col("amount_cents"), F.abs("amount_cents")
    sums = labelled.groupBy(*keys, dates.period_start(F.col("posted_at"), period).alias("period_start")).agg(
        _sum_when(label == "income", amount, "income_cents"),
        _sum_when(label == "credit", amount, "credit_cents"),
        _sum_when(label == "recurring", size, "recurring_cents"),
        _sum_when(label == "one-off", size, "discretionary_cents"),
        _sum_when((label == "transfer") & (amount > 0), amount, "transfer_in_cents"),
        _sum_when((label == "transfer") & (amount <= 0), size, "transfer_out_cents"),
        F.sum("amount_cents").cast("bigint").alias("raw_sum_cents"),
        F.count("*").alias("transaction_count"),
    )
    income = F.col("income_cents")
    sums = sums.withColumn("net_cents", income + F.col("credit_cents") - F.col("recurring_cents") - F.col("discretionary_cents"))

    def share(cents: Column) -> Column:
        return F.when(income > 0, cents / income).otherwise(F.lit(0.0))

    sums = sums.withColumns({
        "savings_rate": share(F.col("net_cents")),
        "fixed_ratio": share(F.col("recurring_cents")),
        "discretionary_ratio": share(F.col("discretionary_cents")),
        "classified_sum_cents": F.col("net_cents") + F.col("transfer_in_cents") - F.col("transfer_out_cents"),
    })
    return sums.withColumn("checksum_valid", F.col("classified_sum_cents") == F.col("raw_sum_cents")).withColumn(
        "health", F.when(income <= 0, F.lit("no_income")).when(F.col("savings_rate") >= 0.15, F.lit("positive"))
        .when(F.col("savings_rate") >= -0.05, F.lit("breakeven")).otherwise(F.lit("negative")))


# --- integrity --------------------------------------------------------------------

# What each flag takes off the score.
PENALTIES = {
    "UNMATCHED_TRANSFER": 0.05, "UNCLASSIFIED_CREDIT": 0.10, "DUPLICATE_SUSPECTED": 0.05, "RECONCILIATION_FAILED": 0.20,
    "FUTURE_DATA_LEAK": 0.15, "PENDING_IN_TOTALS": 0.10, "EMPTY_ACCOUNT_FILTER": 0.0,
}
ACTIONABLE = 0.8


def integrity(counts: DataFrame, accounts: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Adds flags, score, actionable and badge; an account choice that is there but empty has a flag of its own.

    Reads unclassified_credit_count, unmatched_transfer_count,
    duplicate_suspect_count and reconciliation_delta_cents; absent ones count 0.
    """
    def n(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) if name in counts.columns else F.lit(0)

    raised = {
        "UNCLASSIFIED_CREDIT": n("unclassified_credit_count") > 0,
        "UNMATCHED_TRANSFER": n("unmatched_transfer_count") > 0,
        "DUPLICATE_SUSPECTED": n("duplicate_suspect_count") > 0,
        "RECONCILIATION_FAILED": F.abs(n("reconciliation_delta_cents")) > 100,
        "EMPTY_ACCOUNT_FILTER": F.lit(accounts is not None and (accounts.isEmpty() if isinstance(accounts, DataFrame) else not accounts)),
    }
    flags = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in raised.items()]))
    penalty = F.lit(0.0)
    for name, hit in raised.items():
        penalty = penalty + F.when(hit, F.lit(PENALTIES[name])).otherwise(F.lit(0.0))
    score = F.greatest(F.lit(0.0), F.lit(1.0) - penalty)
    return counts.withColumn("flags", flags).withColumn("score", score).withColumn(
        "is_actionable", F.col("score") >= ACTIONABLE).withColumn("badge", labels.integrity_badge(F.col("score")))


def integrity_counts(classified: DataFrame, reconciliations: DataFrame | None = None, period: str = "month", keys: Sequence[str] = KEYS) -> DataFrame:
    """What integrity reads besides the totals, per ledger and period: legs of no pair, copies of one merchant, day and
    amount beyond the first, and the signed delta of the largest discrepancy among statements dated in the period."""
    scope = [*keys, "period_start"]
    rows = classified.withColumn("period_start", dates.period_start(F.col("posted_at"), period))
    paired = F.coalesce(F.col("is_paired"), F.lit(False)) if "is_paired" in rows.columns else F.lit(False)
    alike = rows.groupBy(*scope, "merchant_norm", "posted_at", "amount_cents").agg(
        F.count("*").alias("copies"), F.count_if(~paired & (F.col("amount_cents") != 0)).alias("loose"))
    counts = alike.groupBy(*scope).agg(F.sum("loose").alias("unmatched_transfer_count"), F.sum(F.col("copies") - 1).alias("duplicate_suspect_count"))
    if reconciliations is None:
        return counts
    failed = reconciliations.filter("status = 'discrepancy'").withColumn("period_start", dates.period_start(F.col("statement_date"), period))
    worst = failed.groupBy(*scope).agg(F.max_by("delta_cents", F.struct(F.abs("delta_cents"), "account_id")).alias("reconciliation_delta_cents"))
    return counts.join(worst, scope, "full").na.fill(0, ["unmatched_transfer_count", "duplicate_suspect_count", "reconciliation_delta_cents"])


def resolution_tasks(assessed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per task a flagged report asks for."""
    def n(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) if name in assessed.columns else F.lit(0)

    def usd(cents: Column) -> Column:
        return F.format_number(F.abs(cents) / 100, 2)

    def task(flag: str, kind: str, priority: int, cents: Column, *words: Column) -> Column:
        return F.when(F.array_contains("flags", flag), F.struct(
            F.lit(kind).alias("task_type"), F.lit(priority).alias("priority"), cents.cast("bigint").alias("affected_cents"),
            F.concat(*words).alias("description")))

    delta = n("reconciliation_delta_cents")
    tasks = F.array_compact(F.array(
        task("UNCLASSIFIED_CREDIT", "CLASSIFY_CREDIT", 1, n("unclassified_credit_cents"), F.lit("Classify "),
             n("unclassified_credit_count").cast("string"), F.lit(" unclassified credits ($"),
             usd(n("unclassified_credit_cents")), F.lit(")")),
        task("UNMATCHED_TRANSFER", "MATCH_TRANSFER", 2, F.lit(0), F.lit("Match or classify "),
             n("unmatched_transfer_count").cast("string"), F.lit(" unmatched transfers")),
        task("RECONCILIATION_FAILED", "RECONCILE", 1, F.abs(delta), F.lit("Reconcile statement (delta: $"), usd(delta), F.lit(")")),
        task("DUPLICATE_SUSPECTED", "REVIEW_DUPLICATES", 3, F.lit(0), F.lit("Review "),
             n("duplicate_suspect_count").cast("string"), F.lit(" suspected duplicates")),
    ))
    names = ["Critical", "High", "Medium", "Low"]
    scope = [x for x in (*keys, "period_start") if x in assessed.columns]
    return assessed.select(*scope, F.inline(tasks)).withColumn(
        "priority_label", F.get(F.array(*[F.lit(x) for x in names]), F.least(F.col("priority") - 1, F.lit(3))))


# --- categories ---------------------------------------------------------------------

def category_breakdown(classified: DataFrame, period: str = "month", keys: Sequence[str] = KEYS) -> DataFrame:
    """Gross, refunds, net and count per spending category of the report's rows."""
    name = F.coalesce("category_id", F.lit("other"))
    kind = F.col("txn_type")
    return (
        classified.filter(kind.isin(c.EXPENSE, c.REFUND) & ~name.isin(NOT_SPENDING))
        .groupBy(*keys, dates.period_start(F.col("posted_at"), period).alias("period_start"), name.alias("category"))
        .agg(_sum_when(kind == c.EXPENSE, F.abs("amount_cents"), "gross_cents"),
             _sum_when(kind == c.REFUND, F.col("amount_cents"), "refund_cents"), F.count("*").alias("row_count"))
        .filter("gross_cents > 0 or refund_cents > 0")
        .withColumn("net_cents", F.col("gross_cents") - F.col("refund_cents"))
    )


def scan_categories(
    ledger: DataFrame, overrides: DataFrame | None = None, accounts: Sequence[str] | None = None,
    period: str = "month", keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Merchant sums by signed category straight from the ledger, pending rows included.

    Rows are summed by merchant and text, and the rules run once on each different text.
    """
    rows = with_merchant_norm(for_accounts(ledger, accounts or None)).withColumn("description", F.coalesce("description", F.lit("")))
    sign = F.signum("amount_cents").cast("int")
    sums = rows.groupBy(
        *keys, dates.period_start(F.col("posted_at"), period).alias("period_start"), "merchant_norm",
        "description", sign.alias("sign"),
    ).agg(F.sum(F.abs("amount_cents")).alias("cents"), F.count("*").alias("n"))
    chosen = None
    if overrides is not None:
        sums = sums.join(overrides.select(*keys, "merchant_norm", F.col("category_id").alias("user_category")),
                         [*keys, "merchant_norm"], "left")
        chosen = F.col("user_category")
    found = c.with_rule_category(sums, rows, "found")
    return found.withColumn("category", c.signed_category(F.col("sign"), F.col("found"), chosen)).drop("found")


def scan_breakdown(categorised: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Gross, refunds, net and count per category of the scanned sums."""
    return (
        categorised.filter(~F.col("category").isin(NOT_SPENDING))
        .groupBy(*keys, "period_start", "category")
        .agg(_sum_when(F.col("sign") < 0, F.col("cents"), "gross_cents"),
             _sum_when(F.col("sign") > 0, F.col("cents"), "refund_cents"),
             _sum_when(F.col("sign") != 0, F.col("n"), "row_count"))
        .filter("gross_cents > 0 or refund_cents > 0")
        .withColumn("net_cents", F.col("gross_cents") - F.col("refund_cents"))
    )


def top_merchants_by_category(categorised: DataFrame, limit: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """The `limit` largest merchants of each category and period."""
    scope = [*keys, "period_start", "category"]
    sums = categorised.groupBy(*scope, "merchant_norm").agg(
        F.sum("cents").alias("total_cents"), F.sum("n").alias("row_count"))
    order = Window.partitionBy(*scope).orderBy(F.desc("total_cents"), "merchant_norm")
    return sums.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def top_merchants(
    ledger: DataFrame, limit: int = 20, accounts: Sequence[str] | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The merchants of each ledger with the most spending over all time."""
    rows = with_merchant_norm(for_accounts(ledger, accounts or None).filter(posted_only() & (F.col("amount_cents") < 0)))
    sums = rows.groupBy(*keys, "merchant_norm").agg(
        F.count("*").alias("row_count"), F.sum(F.abs("amount_cents")).alias("total_cents"), F.max("posted_at").alias("last_seen"))
    order = Window.partitionBy(*keys).orderBy(F.desc("total_cents"), "merchant_norm")
    return sums.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def with_tracking(merchants: DataFrame, listed: DataFrame, recurring: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Status of merchants: tracked on a subscription or bill list, recurring without being listed, or untracked."""
    def marked(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*keys, "merchant_norm", F.lit(name).alias(name)).distinct()

    rows = merchants.join(marked(listed, "tracked"), [*keys, "merchant_norm"], "left")
    rows = rows.withColumn("recurring", F.lit(None).cast("string")) if recurring is None else rows.join(
        marked(recurring, "recurring"), [*keys, "merchant_norm"], "left")
    return rows.withColumn("status", F.coalesce("tracked", "recurring", F.lit("untracked"))).drop("tracked", "recurring")


def budget_status(breakdown: DataFrame, targets: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Spending against the target of each budgeted category of one period."""
    spent = breakdown.select(*keys, F.col("category").alias("category_id"), F.col("net_cents").alias("spent"))
    used = F.try_divide(F.col("spent_cents") * 100, F.col("target_cents"))
    return (
        targets.select(*keys, "category_id", F.col("monthly_target_cents").alias("target_cents"))
        .join(spent, [*keys, "category_id"], "left")
        .withColumn("spent_cents", F.coalesce("spent", F.lit(0)))
        .withColumn("remaining_cents", F.col("target_cents") - F.col("spent_cents"))
        .withColumn("percent_used", F.round(F.coalesce(used, F.lit(0.0)), 1))
        .drop("spent")
    )


def budget_page(breakdown: DataFrame, targets: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Budgeted and unbudgeted categories together."""
    spent = breakdown.select(*keys, F.col("category").alias("category_id"), "net_cents", "row_count")
    both = targets.filter(~F.col("category_id").isin(NOT_SPENDING)).join(spent, [*keys, "category_id"], "full")
    target, used = F.coalesce("monthly_target_cents", F.lit(0)), F.coalesce("net_cents", F.lit(0))
    return both.select(
        *keys, "category_id", target.alias("target_cents"), used.alias("spent_cents"),
        F.when(target > 0, target - used).otherwise(F.lit(0)).alias("remaining_cents"),
        F.when(target > 0, F.round(used * 100 / target, 1)).otherwise(F.lit(0.0)).alias("percent_used"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
    ).filter("target_cents > 0 or spent_cents > 0")


def budget_totals(status: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    budget, spent = F.sum("target_cents"), F.sum("spent_cents")
    return status.groupBy(*keys).agg(
        budget.alias("total_budget_cents"), spent.alias("total_spent_cents"), (budget - spent).alias("total_remaining_cents"),
        F.round(F.coalesce(F.try_divide(spent * 100, budget), F.lit(0.0)), 1).alias("total_percent_used"))


# --- drill-down ----------------------------------------------------------------------

def scope_filter(scope: str) -> Column:
    """Rows of a drill-down scope."""
    kind, bucket = F.col("txn_type"), F.col("spending_bucket")
    if scope.startswith("category:"):
        return F.coalesce(F.col("category_id") == scope.split(":", 1)[1], F.lit(False))
    if scope.startswith("merchant:"):
        return F.lower("merchant_norm") == scope.split(":", 1)[1].lower()
    scopes = {
        "income": kind == c.INCOME,
        "spend": kind.isin(c.EXPENSE, c.REFUND),
        "recurring": bucket == c.FIXED,
        "discretionary": bucket.isin(c.VARIABLE, c.DISCRETIONARY, c.ONE_OFFS),
        "net": ~kind.isin(c.TRANSFER, c.CREDIT_OTHER),
        "credit_other": kind == c.CREDIT_OTHER,
        "unmatched_transfers": (kind == c.TRANSFER) & (F.col("transfer_status") == "UNMATCHED"),
        "transfer": kind == c.TRANSFER,
    }
    if scope not in scopes:
        raise ValueError(f"unknown scope {scope!r}")
    return F.coalesce(scopes[scope], F.lit(False))


def _scope_value(scope: str) -> Column:
    """What a row adds to its scope's total. Refunds lower spending."""
    kind, amount = F.col("txn_type"), F.col("amount_cents")
    if scope == "spend":
        return F.when(kind == c.REFUND, -amount).otherwise(F.abs(amount))
    if scope == "net":
        return F.when(kind == c.EXPENSE, -F.abs(amount)).otherwise(amount)
    if scope in ("income", "credit_other", "unmatched_transfers"):
        return amount
    return F.abs(amount)


def drill_down(classified: DataFrame, scope: str) -> DataFrame:
    return classified.filter(scope_filter(scope))


def drill_down_totals(
    classified: DataFrame, scope: str, period: str = "month", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Rows and total of a scope, and what it leaves out as transfers and unclassified credits."""
    return drill_down_table(classified, [scope], period, keys).drop("scope")


def drill_down_table(
    classified: DataFrame, scopes: Sequence[str], period: str = "month", keys: Sequence[str] = KEYS
) -> DataFrame:
    """drill_down_totals of several scopes, named by the column scope, in one pass over the rows."""
    figures = {str(n): _scope_figures(scope) for n, scope in enumerate(scopes)}
    sums = classified.groupBy(*keys, dates.period_start(F.col("posted_at"), period).alias("period_start")).agg(
        *[col.alias(f"{n}_{name}") for n, columns in figures.items() for name, col in columns.items()])
    rows = [F.struct(F.lit(scope).alias("scope"), *[F.col(f"{n}_{name}").alias(name) for name in figures[str(n)]]) for n, scope in enumerate(scopes)]
    return sums.select(*keys, "period_start", F.inline(F.array(*rows)))


def _scope_figures(scope: str) -> dict[str, Column]:
    inside = scope_filter(scope)
    outside, kind, size = ~inside, F.col("txn_type"), F.abs("amount_cents")
    columns = [
        F.count_if(inside).alias("row_count"), _sum_when(inside, _scope_value(scope), "scope_total_cents"),
        F.count_if(outside & (kind == c.TRANSFER)).alias("excluded_transfer_count"),
        _sum_when(outside & (kind == c.TRANSFER), size, "excluded_transfer_cents"),
        F.count_if(outside & (kind == c.CREDIT_OTHER)).alias("excluded_credit_count"),
        _sum_when(outside & (kind == c.CREDIT_OTHER), size, "excluded_credit_cents"),
    ]
    names = ["row_count", "scope_total_cents", "excluded_transfer_count", "excluded_transfer_cents", "excluded_credit_count", "excluded_credit_cents"]
    return dict(zip(names, columns))


def category_merchants(
    ledger: DataFrame, category: str, start: str, end: str, overrides: DataFrame | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Spending of a category by merchant; the rows come from category_rows."""
    rows = with_merchant_norm(ledger.filter(dates.in_range(F.col("posted_at"), start, end) & (F.col("amount_cents") < 0)))
    sums = rows.groupBy(*keys, "merchant_norm").agg(
        F.sum(F.abs("amount_cents")).alias("total_cents"), F.count("*").alias("row_count"))
    found = c.category_of(F.col("merchant_norm"), F.lit(""))
    if overrides is not None:
        sums = sums.join(overrides.select(*keys, "merchant_norm", "category_id"), [*keys, "merchant_norm"], "left")
        found = F.coalesce("category_id", found)
    return sums.withColumn("category", found).filter(F.col("category") == category).select(
        *keys, "merchant_norm", "total_cents", "row_count")


def category_rows(ledger: DataFrame, merchants: DataFrame, start: str, end: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The charges behind category_merchants."""
    rows = with_merchant_norm(ledger.filter(dates.in_range(F.col("posted_at"), start, end) & (F.col("amount_cents") < 0)))
    return rows.join(merchants.select(*keys, "merchant_norm"), [*keys, "merchant_norm"], "left_semi")


# --- review ----------------------------------------------------------------------------

def review_coverage(classified: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts by type, categorised share of expenses, confidence split."""
    kind = F.col("txn_type")
    sure = F.col("confidence") >= 0.8
    named = (kind == c.EXPENSE) & F.coalesce(F.col("category_id") != "other", F.lit(False))
    expenses = F.count_if(kind == c.EXPENSE)
    return classified.groupBy(*keys).agg(
        F.count("*").alias("total_count"),
        *[F.count_if(kind == k).alias(f"{k.lower()}_count") for k in (c.INCOME, c.EXPENSE, c.TRANSFER, c.REFUND, c.CREDIT_OTHER)],
        F.count_if(named).alias("categorized_count"), (expenses - F.count_if(named)).alias("uncategorized_count"),
        F.when(expenses > 0, F.bround(F.count_if(named) / expenses * 100).cast("int")).otherwise(F.lit(100)).alias("categorized_percent"),
        F.count_if(sure).alias("high_confidence_count"), F.count_if(~sure).alias("low_confidence_count"))


def low_confidence_rows(classified: DataFrame) -> DataFrame:
    return classified.filter((F.col("confidence") < 0.8) & (F.col("reason_code") != "USER_OVERRIDE"))


def uncategorised_rows(classified: DataFrame) -> DataFrame:
    return classified.filter((F.col("txn_type") == c.EXPENSE) & (F.coalesce("category_id", F.lit("other")) == "other"))


def with_notes_and_tags(rows: DataFrame, notes: DataFrame, tags: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds note and the sorted tag list of each fingerprint."""
    tag_lists = tags.select(*keys, "fingerprint", "tag").distinct().groupBy(*keys, "fingerprint").agg(
        F.sort_array(F.collect_list("tag")).alias("tags"))
    return rows.join(notes.select(*keys, "fingerprint", "note"), [*keys, "fingerprint"], "left").join(
        tag_lists, [*keys, "fingerprint"], "left")


# --- report identity ---------------------------------------------------------------------

def report_hash(reports: DataFrame) -> DataFrame:
    """Adds report_hash: 16 hex digits over dates, totals, count and versions in key order."""
    doc = F.to_json(F.struct(
        F.lit(CLASSIFIER_VERSION).alias("classifier_version"), F.col("period_end").cast("string").alias("end_date"),
        F.lit(REPORT_VERSION).alias("report_version"), F.col("period_start").cast("string").alias("start_date"),
        F.struct(*[F.col(n) for n in sorted(TOTALS)]).alias("totals"), "transaction_count"))
    return reports.withColumn("report_hash", F.substring(F.sha2(doc, 256), 1, 16))


def report_document(reports: DataFrame, overrides: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Report and the number of active overrides as one JSON text per report."""
    rows = report_hash(reports)
    if overrides is None:
        rows = rows.withColumn("overrides", F.lit(0).cast("bigint"))
    else:
        rows = rows.join(overrides.groupBy(*keys).agg(F.count("*").alias("overrides")), list(keys), "left").na.fill(0, ["overrides"])
    totals = F.struct(*[F.col(n) for n in TOTALS]).alias("totals")
    return rows.select(*keys, "period_start", "report_hash", F.to_json(F.struct(
        "period_label", F.col("period_start").cast("string").alias("start_date"),
        F.col("period_end").cast("string").alias("end_date"), totals, "transaction_count", "report_hash",
        F.col("overrides").alias("active_overrides"))).alias("document"))
