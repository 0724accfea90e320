"""Export tables with fixed columns, safe to open in a spreadsheet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, money, text
from ..operators.classify import vendor_family
from ..operators.scan import KEYS, look_back, with_merchant_norm


def csv_safe_columns(df: DataFrame) -> DataFrame:
    """Guards every text column against formula injection."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({name: text.csv_safe(F.col(name)) for name in texts}) if texts else df


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Guarded CSV files with a header, written by all tasks."""
    csv_safe_columns(df).write.mode(mode).partitionBy(*partition_by).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "append") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def _usd(name: str) -> Column:
    return money.plain_usd(F.col(name))


def transactions(ledger: DataFrame, as_of: str, days: int = 400, keys: Sequence[str] = KEYS) -> DataFrame:
    """Enriched transactions: direction, amounts in dollars, payee, vendor family."""
    rows = with_merchant_norm(look_back(ledger, as_of, days))
    amount = F.col("amount_cents")
    family = vendor_family(F.col("merchant_norm"))
    return rows.select(
        *keys, "posted_at", "account_id",
        F.when(amount < 0, F.lit("outflow")).when(amount > 0, F.lit("inflow")).otherwise(F.lit("zero")).alias("direction"),
        _usd("amount_cents").alias("amount_usd"), money.plain_usd(F.abs(amount)).alias("abs_amount_usd"), "amount_cents",
        "currency", text.csv_safe(F.col("merchant_norm")).alias("payee_norm"), family["family"].alias("family"),
        family["subtype"].alias("subtype"), text.csv_safe(F.col("merchant")).alias("merchant"),
        text.csv_safe(F.col("description")).alias("description"))


def actions(candidates: DataFrame, watchlist: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Subscription candidates with the watch marks of their payee."""
    marks = watchlist.select(*keys, F.col("payee_norm").alias("label"), "status", "note", "handled_at")
    rows = candidates.join(marks, [*keys, "label"], "left")
    return rows.select(
        *keys, text.csv_safe(F.col("label")).alias("payee_norm"), "family", "subtype", "monthly_est_cents", "cadence_guess",
        "occurrences", "amount_median_cents", "avg_delta_days", "confidence", "last_seen", "next_expected",
        F.coalesce("status", F.lit("")).alias("status"), text.csv_safe(F.col("note")).alias("note"),
        F.coalesce(F.col("handled_at").cast("string"), F.lit("")).alias("handled_at"))


def alerts(feed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return feed.select(*keys, "posted_at", text.csv_safe(F.col("merchant_norm")).alias("merchant"), _usd("amount_cents").alias("amount_usd"),
                       "pattern_type", "severity", text.csv_safe(F.col("detail")).alias("detail"))


def duplicates(groups: DataFrame, members: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Duplicate groups with their merchants in one text; a group lists distinct merchants of one ledger."""
    group = [*keys, "group_type", "group_name"]
    names = members.groupBy(*group).agg(F.array_join(F.sort_array(F.collect_set("merchant_norm")), "; ").alias("merchants"))
    return groups.join(names, group).select(
        *keys, "group_type", text.csv_safe(F.col("merchants")).alias("merchants"),
        _usd("total_monthly_cents").alias("monthly_total_usd"), "severity", text.csv_safe(F.col("detail")).alias("detail"))


def subscriptions(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return rows.select(
        *keys, text.csv_safe(F.col("merchant_norm")).alias("merchant"), _usd("monthly_cents").alias("monthly_usd"), "cadence",
        "first_seen", "last_seen", F.when(F.col("is_duplicate"), F.lit("yes")).otherwise(F.lit("no")).alias("is_duplicate"))


def period_summary(trends: DataFrame, period: str = "month", keys: Sequence[str] = KEYS) -> DataFrame:
    """Periods with figures, averages and trends in dollars."""
    names = ["income", "recurring", "discretionary"]
    return trends.select(
        *keys, dates.period_label(F.col("period_start"), period).alias("period"), F.col("period_start").alias("start_date"),
        dates.period_end(F.col("period_start"), period).alias("end_date"),
        *[_usd(f"{n}_cents").alias(f"{n}_usd") for n in [*names, "net"]],
        *[_usd(f"avg_{n}_cents").alias(f"avg_{n}_usd") for n in names], *[f"{n}_trend" for n in names], "transaction_count")


def drill_down(rows: DataFrame, accounts_dim: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Drill-down rows; order by date descending when writing."""
    names = accounts_dim.select("account_id", F.col("name").alias("account_name"))
    label = F.coalesce(F.nullif(F.col("merchant_norm"), F.lit("")), F.nullif(F.col("description"), F.lit("")), F.lit("Unknown"))
    return rows.join(names, "account_id", "left").select(
        *keys, F.col("posted_at").alias("date"), text.csv_safe(label).alias("merchant"), _usd("amount_cents").alias("amount_usd"),
        F.col("txn_type").alias("type"), F.coalesce("category_id", F.lit("")).alias("category"),
        text.csv_safe(F.coalesce("account_name", F.lit("Unknown"))).alias("account"), F.col("reason_code").alias("reason"))
