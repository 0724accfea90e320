"""Closing the books: snapshots of periods, late rows, statements, month close, ledger figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators.scan import KEYS, posted_only, with_merchant_norm
from .period_report import TOTALS, report_hash

MATCHED_CENTS = 100


# --- ledger identity ----------------------------------------------------------

def snapshot_ids(ledger: DataFrame, runs: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """12 hex digits that change when rows or ingest runs do."""
    state = ledger.groupBy(*keys).agg(
        F.count("*").alias("row_count"), F.max("posted_at").alias("latest_posted"),
        F.max(F.coalesce(F.col("updated_at"), F.col("posted_at").cast("timestamp"))).alias("latest_updated"))
    return with_snapshot_id(state, runs, keys)


def with_snapshot_id(state: DataFrame, runs: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds the id to row_count, latest_posted and latest_updated of each ledger."""
    if runs is None:
        state = state.withColumn("latest_run", F.lit(None).cast("bigint"))
    else:
        state = state.join(runs.groupBy(*keys).agg(F.max("run_id").alias("latest_run")), list(keys), "left")
    parts = [F.col("row_count"), F.col("latest_posted"), F.date_format("latest_updated", "yyyy-MM-dd HH:mm:ss"), F.col("latest_run")]
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return state.withColumn("snapshot_id", F.substring(F.sha2(joined, 256), 1, 12))


def ledger_stats(ledger: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows, date range, first and last ingest of each ledger."""
    return ledger.groupBy(*keys).agg(
        F.count("*").alias("row_count"), F.min("posted_at").alias("earliest"), F.max("posted_at").alias("latest"),
        F.min("created_at").alias("first_ingest"), F.max("updated_at").alias("last_update"))


def run_history(runs: DataFrame, limit: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """The newest ingest runs of each ledger; place 1 is the last run."""
    order = Window.partitionBy(*keys).orderBy(F.desc("ran_at"), F.desc("run_id"))
    return runs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def newest_rows(ledger: DataFrame, by: str = "created_at", limit: int = 15, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows last inserted, or with by='updated_at' last changed after insert."""
    rows = ledger.filter("updated_at > created_at") if by == "updated_at" else ledger
    order = Window.partitionBy(*keys).orderBy(F.desc(by), "fingerprint")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def month_close(ledger: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Figures and checksum of each month, pending rows included.

    The checksum is the sum of 60-bit pieces of each row's SHA-1: it does not
    depend on row order, so no month has to be sorted in one place.
    """
    month = [*keys, "month"]
    rows = ledger.withColumn("month", F.trunc("posted_at", "month"))
    amount = F.col("amount_cents")
    line = F.concat_ws("|", F.col("posted_at").cast("string"), amount.cast("string"), F.coalesce("fingerprint", F.lit("")))
    piece = F.conv(F.substring(F.sha1(line), 1, 15), 16, 10).cast("decimal(20,0)")
    days = rows.groupBy(*month, "posted_at").agg(
        F.count("*").alias("n"), F.sum(F.when(amount > 0, amount).otherwise(F.lit(0))).alias("income"),
        F.sum(F.when(amount < 0, -amount).otherwise(F.lit(0))).alias("spend"), F.sum(piece).cast("decimal(38,0)").alias("check"))
    order = Window.partitionBy(*month).orderBy("posted_at")
    gap = F.datediff("posted_at", F.lag("posted_at").over(order))
    sums = days.withColumn("gap", gap).groupBy(*month).agg(
        F.sum("income").alias("income_cents"), F.sum("spend").alias("spend_cents"), F.sum("n").alias("row_count"),
        F.count("*").alias("coverage_days"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap_days"),
        F.sum("check").cast("decimal(38,0)").cast("string").alias("checksum"))
    repeats = rows.filter("fingerprint <> ''").groupBy(*month, "fingerprint").agg(F.count("*").alias("n")).filter("n > 1")
    repeats = repeats.groupBy(*month).agg(F.count("*").alias("repeat_kinds"), F.sum(F.col("n") - 1).alias("repeat_rows"))
    return sums.withColumn("net_cents", F.col("income_cents") - F.col("spend_cents")).join(repeats, month, "left").na.fill(
        0, ["repeat_kinds", "repeat_rows"])


# --- closed periods -------------------------------------------------------------

def close_periods(
    reports: DataFrame, snapshots: DataFrame, closed_at: str, account_filter: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Snapshot rows of the given reports, to be appended to the table of closed periods."""
    chosen = F.lit(None).cast("array<string>") if account_filter is None else F.array(*[F.lit(a) for a in sorted(account_filter)])
    hashed = report_hash(reports).join(snapshots.select(*keys, "snapshot_id"), list(keys), "left")
    period_id = F.substring(F.sha2(F.concat_ws("|", *keys, "period_start", "period_end", F.lit(closed_at), "report_hash"), 256), 1, 16)
    return hashed.select(
        *keys, period_id.alias("closed_period_id"), "period_start", "period_end",
        F.lit(closed_at).cast("timestamp").alias("closed_at"), *TOTALS, "net_cents", "transaction_count", "report_hash",
        "snapshot_id", chosen.alias("account_filter"))


def close_fingerprints(closed: DataFrame, ledger: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Fingerprints a period holds when it is closed, for telling late rows apart later."""
    rows = ledger.filter(posted_only()).select(*keys, "fingerprint", "account_id", "posted_at")
    return _in_period(closed, rows, keys).select(*keys, "closed_period_id", "fingerprint")


def current_closes(closed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The latest close of each range and filter; earlier ones are superseded."""
    same = Window.partitionBy(*keys, "period_start", "period_end", F.coalesce(F.array_join("account_filter", ","), F.lit("*")))
    latest = F.row_number().over(same.orderBy(F.desc("closed_at"), "closed_period_id"))
    return closed.withColumn("place", latest).withColumn(
        "status", F.when(F.col("place") == 1, F.lit("closed")).otherwise(F.lit("superseded"))).drop("place")


def _in_period(closed: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows inside closed periods, met month by month rather than by comparing every row to every period."""
    last_month = F.trunc(F.date_sub("period_end", 1), "month")
    spans = closed.select(*keys, "closed_period_id", "period_start", "period_end", "account_filter", F.explode(F.sequence(
        F.trunc("period_start", "month"), last_month, F.make_interval(months=F.lit(1)))).alias("month"))
    seen = F.col("account_filter").isNull() | F.array_contains("account_filter", F.col("account_id"))
    return rows.withColumn("month", F.trunc("posted_at", "month")).join(spans, [*keys, "month"]).filter(
        (F.col("posted_at") >= F.col("period_start")) & (F.col("posted_at") < F.col("period_end")) & seen)


def late_rows(
    closed: DataFrame, fingerprints: DataFrame, ledger: DataFrame, recorded: DataFrame | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Posted rows now in a closed period that were not there at its close and are not recorded yet."""
    rows = with_merchant_norm(ledger.filter(posted_only()))
    inside = _in_period(closed, rows, keys).select(
        *keys, "closed_period_id", "fingerprint", "posted_at", "amount_cents", "merchant_norm",
        text.raw_description(F.col("merchant"), F.col("description")).alias("description"))
    scope = [*keys, "closed_period_id", "fingerprint"]
    fresh = inside.join(fingerprints.select(*scope), scope, "left_anti")
    if recorded is not None:
        fresh = fresh.join(recorded.select(*scope), scope, "left_anti")
    return fresh.withColumn("adjustment_type", F.lit("new_txn")).withColumn("status", F.lit("pending"))


def adjustment_summary(closed: DataFrame, adjustments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pending adjustments of each closed period and the net they lead to."""
    scope = [*keys, "closed_period_id"]
    pending = adjustments.filter("status = 'pending'").groupBy(*scope).agg(
        F.count("*").alias("pending_count"), F.sum("amount_cents").alias("adjustment_cents"))
    return closed.select(*scope, "period_start", "period_end", "net_cents").join(pending, scope, "left").na.fill(
        0, ["pending_count", "adjustment_cents"]).withColumn("adjusted_net_cents", F.col("net_cents") + F.col("adjustment_cents"))


def statement_matched(ledger: DataFrame, statement_matches: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Ledger rows confirmed on a statement."""
    return ledger.join(statement_matches.select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_semi")


def statement_unmatched(ledger: DataFrame, statement_matches: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return ledger.join(statement_matches.select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_anti")


# --- reconciliation ---------------------------------------------------------------

def account_balances(ledger: DataFrame, as_of: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Balance, rows, first and last date per account up to and including the day."""
    rows = ledger.filter(posted_only() & (F.col("posted_at") <= dates.as_date(as_of)))
    return rows.groupBy(*keys, "account_id").agg(
        F.sum("amount_cents").alias("balance_cents"), F.count("*").alias("row_count"),
        F.min("posted_at").alias("first_date"), F.max("posted_at").alias("last_date"))


def reconcile(statements: DataFrame, ledger: DataFrame, accounts_dim: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Statement balances against the ledger: delta, status and direction.

    Days are summed once and carried forward in a running balance per account,
    so each statement reads one row however many statements there are.
    """
    account = [*keys, "account_id"]
    days = ledger.filter(posted_only()).groupBy(*account, F.col("posted_at").alias("day")).agg(
        F.sum("amount_cents").alias("cents"), F.count("*").alias("n"))
    marks = statements.select(*account, F.col("statement_date").alias("day"), "statement_balance_cents")
    events = days.withColumn("statement_balance_cents", F.lit(None).cast("bigint")).unionByName(marks, allowMissingColumns=True)
    upto = Window.partitionBy(*account).orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    moved = F.when(F.col("n").isNotNull(), F.col("day"))
    run = events.select(
        *account, F.col("day").alias("statement_date"), "statement_balance_cents",
        F.coalesce(F.sum("cents").over(upto), F.lit(0)).alias("calculated_balance_cents"),
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("row_count"),
        F.min(moved).over(upto).alias("first_date"), F.max(moved).over(upto).alias("last_date"))
    delta = F.col("statement_balance_cents") - F.col("calculated_balance_cents")
    names = accounts_dim.select("account_id", F.col("name").alias("account_name"))
    return (
        run.filter("statement_balance_cents is not null").withColumn("delta_cents", delta)
        .withColumn("is_matched", F.abs("delta_cents") <= MATCHED_CENTS)
        .withColumn("status", F.when(F.col("is_matched"), F.lit("matched")).otherwise(F.lit("discrepancy")))
        .withColumn("direction", F.when(F.col("delta_cents") > 0, F.lit("missing_income"))
                    .when(F.col("delta_cents") < 0, F.lit("missing_expense")).otherwise(F.lit("balanced")))
        .join(names, "account_id", "left").withColumn("account_name", F.coalesce("account_name", "account_id"))
    )


def open_discrepancies(events: DataFrame, limit: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Unresolved reconciliations, the largest delta first."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.abs("delta_cents")), "account_id", "statement_date")
    rows = events.filter("status = 'discrepancy'").withColumn("place", F.row_number().over(order))
    return rows if limit is None else rows.filter(F.col("place") <= limit)


def reconciliation_history(events: DataFrame, limit: int = 50, keys: Sequence[str] = KEYS) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("statement_date"), "account_id")
    return events.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def reconciliation_patterns(events: DataFrame, least: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Accounts whose delta is steady, or grows, over at least three reconciliations."""
    account = [*keys, "account_id"]
    newest = Window.partitionBy(*account).orderBy(F.desc("statement_date"))
    placed = events.withColumn("age", F.row_number().over(newest)).withColumn(
        "n", F.count("*").over(Window.partitionBy(*account)))
    delta, size = F.col("delta_cents"), F.abs("delta_cents")
    mean = F.floor(F.sum(delta) / F.count("*"))
    older = (F.col("age") > 3) | ((F.col("n") <= 3) & (F.col("age") == F.col("n")))
    stats = placed.groupBy(*account).agg(
        F.count("*").alias("delta_count"), mean.cast("bigint").alias("mean_cents"),
        (F.min(delta) > 0).alias("all_up"), (F.max(delta) < 0).alias("all_down"),
        F.avg(size.cast("double")).alias("size_mean"), F.avg((size * size).cast("double")).alias("square_mean"),
        F.avg(F.when(F.col("age") <= 3, size)).alias("recent"), F.avg(F.when(older, size)).alias("older"),
        F.count_if(F.col("status") == "discrepancy").alias("unresolved_count"),
        F.coalesce(F.sum(F.when(F.col("status") == "discrepancy", size)), F.lit(0)).alias("unresolved_cents"),
    ).filter(F.col("delta_count") >= least)
    centre = F.abs("mean_cents").cast("double")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("square_mean") - 2 * centre * F.col("size_mean") + centre * centre))
    cv = F.try_divide(spread, centre)
    steady = (F.col("all_up") | F.col("all_down")) & (centre > 100) & (cv < 0.3)
    growing = (F.col("older") > 0) & (F.col("recent") > F.col("older") * 1.5)

    def kind(condition: Column, name: str, cents: Column, confidence: Column) -> Column:
        return F.when(condition, F.struct(F.lit(name).alias("pattern_type"), cents.cast("bigint").alias("avg_delta_cents"),
                                          confidence.alias("confidence")))

    found = F.array_compact(F.array(
        kind(steady, "consistent_delta", F.col("mean_cents"), 1 - cv),
        kind(growing, "growing_delta", F.col("recent"), F.lit(0.7))))
    return stats.select(*account, "delta_count", "unresolved_count", "unresolved_cents", F.inline_outer(found))


def missing_candidates(
    events: DataFrame, ledger: DataFrame, tolerance_percent: float = 20.0, limit: int = 10, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Rows of the 30 days before a statement that could explain its delta, the nearest amounts first."""
    account = [*keys, "account_id"]
    target = F.abs("delta_cents")
    room = F.floor(target * tolerance_percent / 100)
    months = F.array_distinct(F.array(F.trunc(F.date_sub("statement_date", 30), "month"), F.trunc("statement_date", "month")))
    gaps = events.filter("delta_cents <> 0").select(
        *account, "statement_date", "delta_cents", (target - room).alias("low"), (target + room).alias("high"),
        (F.col("delta_cents") > 0).alias("credit"), F.explode(months).alias("month"))
    rows = ledger.select(
        *account, "posted_at", "amount_cents", "fingerprint", F.coalesce("merchant", "description", F.lit("")).alias("payee"),
        F.trunc("posted_at", "month").alias("month"))
    size = F.abs("amount_cents")
    hits = rows.join(gaps, [*account, "month"]).filter(
        F.datediff("statement_date", "posted_at").between(0, 30) & size.between(F.col("low"), F.col("high"))
        & (F.col("amount_cents") != 0) & ((F.col("amount_cents") > 0) == F.col("credit")))
    off = F.abs(size - F.abs("delta_cents"))
    order = Window.partitionBy(*account, "statement_date").orderBy("off", "posted_at", "fingerprint")
    return (
        hits.withColumn("off", off).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
        .withColumn("match_quality", 1 - F.col("off") / F.abs("delta_cents"))
        .select(*account, "statement_date", "delta_cents", "place", "posted_at", "amount_cents", "payee", "fingerprint", "match_quality")
    )


# --- audit log ----------------------------------------------------------------------

def audit_log(
    log: DataFrame, entity_type: str | None = None, entity_id: str | None = None, event_type: str | None = None,
    since: str | None = None, limit: int | None = None, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The audit events that pass the filters, all of them or the newest `limit` of each ledger, with their place."""
    for name, value in (("entity_type", entity_type), ("entity_id", entity_id), ("event_type", event_type)):
        if value is not None:
            log = log.filter(F.col(name) == value)
    if since is not None:
        log = log.filter(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    if limit is None:
        return log
    newest = Window.partitionBy(*keys).orderBy(F.desc("timestamp"), "entity_id")
    return log.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= limit)


def entity_history(log: DataFrame, entity_type: str, entity_id: str) -> DataFrame:
    """Every event of one entity."""
    return audit_log(log, entity_type, entity_id)
