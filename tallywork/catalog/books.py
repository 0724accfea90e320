"""Queries: closing, reconciliation, ledger figures, ingest and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import merge
from ..operators import recurring as rec
from ..operators.detectors import alert_feed
from ..operators.duplicates import group_members, group_summary, kept_members
from ..plans import closing
from ..plans import period_report as pr
from ..session import store
from ..sinks import exports
from ..sources import bank_files as bf
from . import check_sql as k
from .detection import FEED_TEXTS
from .recurrence import ALL_GROUPS, STRICT_CHECK, SUBSCRIBED
from .registry import Inputs, query
from .reports import trends_check

NOW = "2001-11-05 00:00:00"


# --- ledger figures ---------------------------------------------------------------

@query("owner_id row_count earliest:text latest:text", "SELECT owner_id, count(*) AS row_count, min(posted_at) AS earliest, max(posted_at) AS latest FROM ledger GROUP BY 1")
def ledger_stats(x: Inputs) -> DataFrame:
    return closing.ledger_stats(x.ledger)


@query("owner_id snapshot_id:text row_count", """
    SELECT l.owner_id, n AS row_count, left(sha256(n || '|' || posted || '|' || strftime(updated, '%Y-%m-%d %H:%M:%S') || '|' || run), 12) AS snapshot_id
    FROM (SELECT owner_id, count(*) AS n, max(posted_at) AS posted, max(updated_at) AS updated FROM ledger GROUP BY 1) l
    JOIN (SELECT owner_id, max(run_id) AS run FROM runs GROUP BY 1) r USING (owner_id)""")
def snapshot_ids(x: Inputs) -> DataFrame:
    return closing.snapshot_ids(x.ledger, x.rules("runs"))


@query("owner_id place run_id txns_fetched", """
    SELECT owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY ran_at DESC, run_id DESC) AS place, run_id, txns_fetched FROM runs QUALIFY place <= 20""")
def run_history(x: Inputs) -> DataFrame:
    return closing.run_history(x.rules("runs"))


@query("owner_id place fingerprint:text", """
    SELECT owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, fingerprint) AS place, fingerprint FROM ledger QUALIFY place <= 15""")
def newest_inserts(x: Inputs) -> DataFrame:
    return closing.newest_rows(x.ledger)


@query("owner_id place fingerprint:text", """
    SELECT owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY updated_at DESC, fingerprint) AS place, fingerprint FROM ledger
    WHERE updated_at > created_at QUALIFY place <= 15""")
def newest_updates(x: Inputs) -> DataFrame:
    return closing.newest_rows(x.ledger, "updated_at")


@query("owner_id month:text income_cents spend_cents net_cents row_count coverage_days max_gap_days repeat_kinds repeat_rows", """
    WITH r AS (SELECT *, CAST(date_trunc('month', posted_at) AS DATE) AS month FROM ledger),
    d AS (SELECT owner_id, month, posted_at, posted_at - lag(posted_at) OVER (PARTITION BY owner_id, month ORDER BY posted_at) AS gap FROM (SELECT DISTINCT owner_id, month, posted_at FROM r)),
    g AS (SELECT owner_id, month, count(*) AS coverage_days, coalesce(max(gap), 0) AS max_gap_days FROM d GROUP BY 1, 2),
    f AS (SELECT owner_id, month, count(*) AS repeat_kinds, sum(n - 1) AS repeat_rows FROM (SELECT owner_id, month, fingerprint, count(*) AS n FROM r GROUP BY 1, 2, 3 HAVING count(*) > 1) GROUP BY 1, 2),
    s AS (SELECT owner_id, month, sum(greatest(amount_cents, 0)) AS income_cents, sum(greatest(-amount_cents, 0)) AS spend_cents, sum(amount_cents) AS net_cents, count(*) AS row_count FROM r GROUP BY 1, 2)
    SELECT s.*, coverage_days, max_gap_days, coalesce(repeat_kinds, 0) AS repeat_kinds, coalesce(repeat_rows, 0) AS repeat_rows FROM s JOIN g USING (owner_id, month) LEFT JOIN f USING (owner_id, month)""")
def month_close(x: Inputs) -> DataFrame:
    return closing.month_close(x.ledger)


@query("owner_id month:text checksum:text", """
    SELECT owner_id, CAST(date_trunc('month', posted_at) AS DATE) AS month,
        CAST(sum(CAST('0x' || left(sha1(posted_at || '|' || amount_cents || '|' || coalesce(fingerprint, '')), 15) AS HUGEINT)) AS VARCHAR) AS checksum FROM ledger GROUP BY 1, 2""")
def month_checksums(x: Inputs) -> DataFrame:
    return closing.month_close(x.ledger)


# --- closing -------------------------------------------------------------------------

def _reports(x: Inputs) -> DataFrame:
    return pr.period_reports(pr.period_totals(x.typed_months(3, "2001-09-30")), x.accounts, "2001-09-30", 3)


def _closed(x: Inputs) -> DataFrame:
    """July to September closed at the start of October, September once more later."""
    snapshots = closing.snapshot_ids(x.ledger)
    first = closing.close_periods(_reports(x), snapshots, "2001-10-01 00:00:00")
    again = closing.close_periods(_reports(x).filter("period_start = DATE '2001-09-01'"), snapshots, "2001-10-02 00:00:00")
    return first.unionByName(again)


@query("owner_id period_start:text period_end:text status:text net_cents transaction_count", """
    WITH r AS (SELECT * FROM reports WHERE period_start BETWEEN DATE '2001-07-01' AND DATE '2001-09-01')
    SELECT owner_id, period_start, CAST(period_start + INTERVAL 1 MONTH AS DATE) AS period_end, net_cents, transaction_count,
        CASE WHEN period_start = DATE '2001-09-01' THEN 'superseded' ELSE 'closed' END AS status FROM r
    UNION ALL SELECT owner_id, period_start, DATE '2001-10-01', net_cents, transaction_count, 'closed' FROM r WHERE period_start = DATE '2001-09-01'""")
def closed_periods(x: Inputs) -> DataFrame:
    return closing.current_closes(_closed(x))


_LATE = """SELECT owner_id, CAST(date_trunc('month', posted_at) AS DATE) AS period_start, fingerprint, posted_at, amount_cents, merchant_norm FROM posted
    WHERE posted_at >= DATE '2001-07-01' AND posted_at < DATE '2001-10-01' AND fingerprint LIKE 'e%'"""


def closed_and_held(x: Inputs) -> tuple[DataFrame, DataFrame]:
    """Closed periods and the fingerprints in them at the close; rows whose fingerprint starts with e arrive later."""
    closed = closing.current_closes(_closed(x)).filter("status = 'closed'")
    return closed, closing.close_fingerprints(closed, x.ledger.filter("fingerprint not like 'e%'"))


def _late(x: Inputs) -> tuple[DataFrame, DataFrame]:
    closed, held = closed_and_held(x)
    return closed, closing.late_rows(closed, held, x.ledger)


@query("owner_id period_start:text fingerprint:text posted_at:text amount_cents merchant_norm:text", _LATE)
def late_rows(x: Inputs) -> DataFrame:
    return _late(x)[1].withColumn("period_start", dates.period_start(F.col("posted_at")))


@query("owner_id period_start:text pending_count adjustment_cents adjusted_net_cents", f"""
    SELECT r.owner_id, r.period_start, coalesce(n, 0) AS pending_count, coalesce(c, 0) AS adjustment_cents, net_cents + coalesce(c, 0) AS adjusted_net_cents
    FROM reports r LEFT JOIN (SELECT owner_id, period_start, count(*) AS n, sum(amount_cents) AS c FROM ({_LATE}) GROUP BY 1, 2) l ON l.owner_id = r.owner_id AND l.period_start = r.period_start
    WHERE r.period_start BETWEEN DATE '2001-07-01' AND DATE '2001-09-01'""")
def adjustment_summary(x: Inputs) -> DataFrame:
    closed, late = _late(x)
    return closing.adjustment_summary(closed, late)


@query("owner_id matched_count unmatched_count", """
    SELECT owner_id, count(CASE WHEN fingerprint LIKE 'b%' THEN 1 END) AS matched_count, count(CASE WHEN fingerprint NOT LIKE 'b%' THEN 1 END) AS unmatched_count
    FROM ledger GROUP BY owner_id""")
def statement_matched_rows(x: Inputs) -> DataFrame:
    confirmed = x.rules("notes").select("owner_id", "fingerprint")
    on = closing.statement_matched(x.ledger, confirmed).groupBy("owner_id").agg(F.count("*").alias("matched_count"))
    off = closing.statement_unmatched(x.ledger, confirmed).groupBy("owner_id").agg(F.count("*").alias("unmatched_count"))
    both = on.join(off, "owner_id", "full")
    return both.withColumns({name: F.coalesce(name, F.lit(0)) for name in ("matched_count", "unmatched_count")})


# --- reconciliation --------------------------------------------------------------------

@query("owner_id account_id:text balance_cents row_count first_date:text last_date:text", """
    SELECT owner_id, account_id, sum(amount_cents) AS balance_cents, count(*) AS row_count, min(posted_at) AS first_date, max(posted_at) AS last_date
    FROM posted WHERE posted_at <= DATE '2001-06-30' GROUP BY 1, 2""")
def account_balances(x: Inputs) -> DataFrame:
    return closing.account_balances(x.ledger, "2001-06-30")


RECONCILED = """SELECT s.owner_id, s.account_id, s.statement_date, s.statement_balance_cents, b.cents AS calculated_balance_cents, s.statement_balance_cents - b.cents AS delta_cents,
    CASE WHEN abs(s.statement_balance_cents - b.cents) <= 100 THEN 'matched' ELSE 'discrepancy' END AS status
    FROM statements s JOIN (SELECT t.owner_id, t.account_id, t.statement_date, coalesce(sum(p.amount_cents), 0) AS cents FROM statements t
        LEFT JOIN posted p ON p.owner_id = t.owner_id AND p.account_id = t.account_id AND p.posted_at <= t.statement_date GROUP BY 1, 2, 3) b
    ON b.owner_id = s.owner_id AND b.account_id = s.account_id AND b.statement_date = s.statement_date"""


def _events(x: Inputs) -> DataFrame:
    return closing.reconcile(x.rules("statements"), x.ledger, x.accounts)


@query("owner_id account_id:text statement_date:text calculated_balance_cents delta_cents status:text direction:text", f"""
    SELECT *, CASE WHEN delta_cents > 0 THEN 'missing_income' WHEN delta_cents < 0 THEN 'missing_expense' ELSE 'balanced' END AS direction FROM ({RECONCILED}) AS e""")
def statement_reconciliation(x: Inputs) -> DataFrame:
    return _events(x)


@query("owner_id place account_id:text statement_date:text delta_cents", f"""
    SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY abs(delta_cents) DESC, account_id, statement_date) AS place FROM ({RECONCILED}) AS e WHERE status = 'discrepancy'""")
def open_discrepancies(x: Inputs) -> DataFrame:
    return closing.open_discrepancies(_events(x))


@query("owner_id place account_id:text statement_date:text", f"""
    SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY statement_date DESC, account_id) AS place FROM ({RECONCILED}) AS e QUALIFY place <= 4""")
def reconciliation_history(x: Inputs) -> DataFrame:
    return closing.reconciliation_history(_events(x), 4)


@query("owner_id account_id:text delta_count unresolved_count unresolved_cents pattern_type:text avg_delta_cents confidence:real", f"""
    WITH e AS (SELECT *, row_number() OVER (PARTITION BY owner_id, account_id ORDER BY statement_date DESC) AS age, count(*) OVER (PARTITION BY owner_id, account_id) AS n FROM ({RECONCILED})),
    m AS (SELECT owner_id, account_id, CAST(floor(sum(delta_cents) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS mean FROM e GROUP BY 1, 2),
    s AS (SELECT e.owner_id, e.account_id, count(*) AS delta_count, any_value(mean) AS mean, min(delta_cents) > 0 OR max(delta_cents) < 0 AS one_way,
        sqrt(avg(power(abs(delta_cents) - abs(mean), 2))) / nullif(abs(any_value(mean)), 0) AS cv, avg(abs(delta_cents)) FILTER (WHERE age <= 3) AS recent,
        avg(abs(delta_cents)) FILTER (WHERE age > 3 OR (n <= 3 AND age = n)) AS older, count(CASE WHEN status = 'discrepancy' THEN 1 END) AS unresolved_count,
        coalesce(sum(abs(delta_cents)) FILTER (WHERE status = 'discrepancy'), 0) AS unresolved_cents FROM e JOIN m USING (owner_id, account_id) GROUP BY 1, 2 HAVING count(*) >= 3),
    f AS (SELECT owner_id, account_id, 'consistent_delta' AS pattern_type, mean AS avg_delta_cents, 1 - cv AS confidence FROM s WHERE one_way AND abs(mean) > 100 AND cv < 0.3
        UNION ALL SELECT owner_id, account_id, 'growing_delta', CAST(trunc(recent) AS BIGINT), 0.7 FROM s WHERE older > 0 AND recent > older * 1.5)
    SELECT s.owner_id, s.account_id, delta_count, unresolved_count, unresolved_cents, pattern_type, avg_delta_cents, confidence FROM s LEFT JOIN f USING (owner_id, account_id)""")
def reconciliation_patterns(x: Inputs) -> DataFrame:
    return closing.reconciliation_patterns(_events(x))


@query("owner_id account_id:text statement_date:text place fingerprint:text match_quality:real", f"""
    SELECT e.owner_id, e.account_id, statement_date, fingerprint, 1 - abs(abs(amount_cents) - abs(delta_cents)) / CAST(abs(delta_cents) AS DOUBLE) AS match_quality,
        row_number() OVER (PARTITION BY e.owner_id, e.account_id, statement_date ORDER BY abs(abs(amount_cents) - abs(delta_cents)), posted_at, fingerprint) AS place
    FROM ({RECONCILED}) AS e JOIN ledger l ON l.owner_id = e.owner_id AND l.account_id = e.account_id AND l.posted_at BETWEEN e.statement_date - 30 AND e.statement_date
        AND (CASE WHEN delta_cents > 0 THEN amount_cents > 0 ELSE amount_cents < 0 END)
        AND abs(amount_cents) BETWEEN abs(delta_cents) - floor(abs(delta_cents) * 20.0 / 100) AND abs(delta_cents) + floor(abs(delta_cents) * 20.0 / 100)
    WHERE delta_cents <> 0 QUALIFY place <= 10""")
def missing_transaction_candidates(x: Inputs) -> DataFrame:
    return closing.missing_candidates(_events(x), x.ledger)


@query("owner_id place entity_id:text event_type:text new_value:text", """
    SELECT owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY timestamp DESC, entity_id) AS place, entity_id, event_type, new_value
    FROM audit_log WHERE event_type = 'TXN_TYPE_OVERRIDE' AND timestamp >= TIMESTAMP '2001-06-01' QUALIFY place <= 100""")
def audit_log(x: Inputs) -> DataFrame:
    """The newest hundred of each ledger."""
    return closing.audit_log(x.rules("audit_log"), "transaction", event_type="TXN_TYPE_OVERRIDE", since="2001-06-01", limit=100)


@query("owner_id entity_id:text event_type:text new_value:text", """
    SELECT owner_id, entity_id, event_type, new_value FROM audit_log WHERE entity_id = (SELECT min(fingerprint) FROM ledger)""")
def entity_history(x: Inputs) -> DataFrame:
    entity = x.ledger.agg(F.min("fingerprint")).first()[0]
    return closing.entity_history(x.rules("audit_log"), "transaction", entity)


# --- ingest: texts as a bank would send them, made from the ledger ------------------------

def usd_text(cents: Column) -> Column:
    """Amount as bank text in one of four styles."""
    plain = F.format_string("%.2f", F.abs(cents) / 100)
    style = F.abs(cents) % 4
    return (
        F.when(style == 0, F.concat(F.when(cents < 0, F.lit("-")).otherwise(F.lit("")), plain))
        .when(style == 1, F.when(cents < 0, F.concat(F.lit("($"), F.format_number(F.abs(cents) / 100, 2), F.lit(")"))).otherwise(F.concat(F.lit("$"), plain)))
        .when(style == 2, F.concat(F.when(cents < 0, F.lit("-$")).otherwise(F.lit("$")), F.format_number(F.abs(cents) / 100, 2)))
        .otherwise(F.concat(F.when(cents < 0, F.lit("- ")).otherwise(F.lit("")), plain))
    )


def _bank_rows(x: Inputs) -> DataFrame:
    """Every ledger row as bank text, stored as a bank's file would be; rows with an f or an e5 fingerprint are damaged."""
    day = F.col("posted_at")
    style = F.dayofmonth(day) % 3
    day_text = F.when(style == 0, F.date_format(day, "yyyy-MM-dd")).when(style == 1, F.date_format(day, "M/d/yyyy")).otherwise(
        F.date_format(day, "yyyy/MM/dd"))
    return store(x.ledger.select(
        "owner_id", "account_id", F.col("fingerprint").alias("row_id"),
        F.when(F.startswith("fingerprint", F.lit("f")), F.lit("soon")).otherwise(day_text).alias("date_text"),
        F.when(F.startswith("fingerprint", F.lit("e5")), F.lit("n/a")).otherwise(usd_text(F.col("amount_cents"))).alias("amount_text"),
        "description", "merchant"))


_PARSED = """SELECT owner_id, account_id, fingerprint AS row_id, posted_at, amount_cents, description, coalesce(nullif(merchant, ''), description) AS label,
    CASE WHEN fingerprint LIKE 'f%' THEN 'date' WHEN fingerprint LIKE 'e5%' THEN 'amount' END AS error FROM ledger"""


@query("owner_id row_id:text posted_at:text amount_cents merchant:text fingerprint:text", f"""
    SELECT owner_id, row_id, posted_at, amount_cents, trim(label) AS merchant,
        'csv_' || left(sha256(posted_at || '|' || amount_cents || '|' || trim(label) || '|' || account_id), 32) AS fingerprint FROM ({_PARSED}) AS p WHERE error IS NULL""")
def parsed_bank_rows(x: Inputs) -> DataFrame:
    return bf.accepted(bf.parse_bank_rows(_bank_rows(x)))


@query("owner_id row_id:text error:text", f"""
    SELECT owner_id, row_id, CASE error WHEN 'date' THEN 'no date in ''soon''' ELSE 'no amount in ''n/a''' END AS error FROM ({_PARSED}) AS p WHERE error IS NOT NULL""")
def rejected_bank_rows(x: Inputs) -> DataFrame:
    return bf.rejected(bf.parse_bank_rows(_bank_rows(x)))


@query("account_id:text row_count error_count first_date:text last_date:text amount_total_cents", f"""
    SELECT account_id, count(*) AS row_count, count(error) AS error_count, min(CASE WHEN row_id NOT LIKE 'f%' THEN posted_at END) AS first_date,
        max(CASE WHEN row_id NOT LIKE 'f%' THEN posted_at END) AS last_date, sum(CASE WHEN row_id LIKE 'e5%' THEN 0 ELSE amount_cents END) AS amount_total_cents
    FROM ({_PARSED}) AS p GROUP BY 1""")
def bank_file_profile(x: Inputs) -> DataFrame:
    return bf.file_profile(bf.parse_bank_rows(_bank_rows(x)))


# Columns of the ledger that bank rows are made of.
PRINTED = ["owner_id", "account_id", "posted_at", "amount_cents", "description", "merchant", "fingerprint"]
_PRINTED = f"""SELECT owner_id, row_id, 'csv_' || left(sha256(posted_at || '|' || amount_cents || '|' || trim(label) || '|' || account_id), 32) AS fp FROM ({_PARSED}) AS p WHERE error IS NULL"""


@query("owner_id imported skipped", f"""
    WITH p AS ({_PRINTED}), known AS (SELECT DISTINCT owner_id, fp FROM p WHERE row_id LIKE 'a%')
    SELECT p.owner_id, count(DISTINCT CASE WHEN k.fp IS NULL THEN p.fp END) AS imported, count(*) - count(DISTINCT CASE WHEN k.fp IS NULL THEN p.fp END) AS skipped
    FROM p LEFT JOIN known k ON k.owner_id = p.owner_id AND k.fp = p.fp GROUP BY 1""", read=PRINTED)
def bank_import_counts(x: Inputs) -> DataFrame:
    batch = bf.accepted(bf.parse_bank_rows(_bank_rows(x)))
    return merge.import_counts(batch, batch.filter("row_id like 'a%'"), ["owner_id"])


@query("owner_id fingerprint:text", f"""
    WITH p AS ({_PRINTED}) SELECT DISTINCT owner_id, fp AS fingerprint FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.owner_id = p.owner_id AND q.fp = p.fp AND q.row_id LIKE 'a%')""")
def new_bank_rows(x: Inputs) -> DataFrame:
    batch = bf.accepted(bf.parse_bank_rows(_bank_rows(x)))
    return merge.new_fingerprints(batch, batch.filter("row_id like 'a%'"), ["owner_id"])


def _feed_pages(x: Inputs) -> DataFrame:
    """The ledger as feed documents, one page per account and quarter; dates alternate between epoch and text."""
    cents = F.col("amount_cents")
    entry = F.create_map(
        F.lit("id"), F.col("source_txn_id"), F.lit("amount"), F.format_string("%.2f", cents / 100),
        F.when(F.dayofmonth("posted_at") % 2 == 0, F.lit("transacted_at")).otherwise(F.lit("posted_at")),
        F.when(F.dayofmonth("posted_at") % 2 == 0, (F.unix_seconds(F.col("posted_at").cast("timestamp")) + 3600).cast("string"))
        .otherwise(F.col("posted_at").cast("string")),
        F.lit("memo"), F.col("description"), F.lit("payee"), F.col("merchant"), F.lit("pending"), F.col("pending").cast("string"))
    quarter = (F.year("posted_at") * 4 + F.quarter("posted_at")).alias("page_no")
    pages = x.ledger.groupBy("owner_id", "account_id", quarter).agg(F.collect_list(entry).alias("transactions"))
    account = F.struct(
        F.col("account_id").alias("id"), F.concat(F.lit("Account "), F.col("page_no").cast("string")).alias("name"),
        F.struct(F.lit("First Bank").alias("name")).alias("org"), "transactions")
    return pages.select("owner_id", "page_no", F.to_json(F.struct(
        F.array(F.concat(F.lit("slow "), (F.col("page_no") % 2).cast("string"))).alias("errors"), F.array(account).alias("accounts"))).alias("document"))


@query("owner_id account_id:text posted_at:text amount_cents description:text merchant:text source_txn_id:text pending:flag fingerprint:text", """
    SELECT owner_id, account_id, posted_at, amount_cents, description, nullif(merchant, '') AS merchant, source_txn_id, pending,
        sha256(account_id || '|' || posted_at || '|' || amount_cents || '|' || upper(trim(regexp_replace(coalesce(merchant, ''), '\\s+', ' ', 'g'))) || '|'
            || upper(trim(regexp_replace(coalesce(description, ''), '\\s+', ' ', 'g')))) AS fingerprint FROM ledger""")
def feed_rows(x: Inputs) -> DataFrame:
    return bf.feed_rows(_feed_pages(x), keys=["owner_id"])


@query("owner_id account_id:text institution:text name:text currency:text", """
    SELECT owner_id, account_id, 'First Bank' AS institution, 'Account ' || max(year(posted_at) * 4 + quarter(posted_at)) AS name, 'USD' AS currency FROM ledger GROUP BY 1, 2""")
def feed_accounts(x: Inputs) -> DataFrame:
    return bf.feed_accounts(_feed_pages(x), ["owner_id"])


@query("owner_id error:text", "SELECT DISTINCT owner_id, 'slow ' || (year(posted_at) * 4 + quarter(posted_at)) % 2 AS error FROM ledger")
def feed_errors(x: Inputs) -> DataFrame:
    return bf.feed_errors(_feed_pages(x), ["owner_id"])


def resent_batch(x: Inputs) -> DataFrame:
    """Rows that come again: some with a new amount, some new to the ledger, some without a source id."""
    amount = F.when(F.startswith("fingerprint", F.lit("1")), F.col("amount_cents") - 1).otherwise(F.col("amount_cents"))
    return x.ledger.filter("left(fingerprint, 1) in ('1', '2', '3', '4')").withColumn("amount_cents", amount).withColumn("page_no", F.lit(1)).withColumn(
        "source_txn_id", F.when(F.startswith("fingerprint", F.lit("4")), F.lit(None).cast("string")).otherwise(F.col("source_txn_id")))


_MERGE_CHANGE = "CASE WHEN left(fingerprint, 1) = '1' THEN 'updated' WHEN left(fingerprint, 1) IN ('3', '4') THEN 'inserted' ELSE 'unchanged' END"


@query("owner_id account_id:text posted_at:text amount_cents currency:text description:text merchant:text fingerprint:text pending:flag source_txn_id:text created_at:text updated_at:text change:text", f"""
    SELECT owner_id, account_id, posted_at, amount_cents - CASE WHEN change = 'updated' THEN 1 ELSE 0 END AS amount_cents, currency, description, merchant, fingerprint, pending,
        CASE WHEN left(fingerprint, 1) = '4' THEN NULL ELSE source_txn_id END AS source_txn_id,
        strftime(CASE WHEN change = 'inserted' THEN TIMESTAMP '{NOW}' ELSE created_at END, '%Y-%m-%d %H:%M:%S') AS created_at,
        strftime(CASE WHEN change = 'unchanged' THEN updated_at ELSE TIMESTAMP '{NOW}' END, '%Y-%m-%d %H:%M:%S') AS updated_at, change
    FROM (SELECT *, {_MERGE_CHANGE} AS change FROM ledger)""")
def ledger_merge(x: Inputs) -> DataFrame:
    """Every row of the ledger after it, without its 3s and 4s, took the batch."""
    return merge.merge_ledger(x.ledger.filter("left(fingerprint, 1) not in ('3', '4')"), resent_batch(x), NOW, keys=["owner_id"])


@query("owner_id inserted updated", """
    SELECT owner_id, count(CASE WHEN left(fingerprint, 1) IN ('3', '4') THEN 1 END) AS inserted, count(CASE WHEN left(fingerprint, 1) = '1' THEN 1 END) AS updated FROM ledger GROUP BY 1""")
def merge_counts(x: Inputs) -> DataFrame:
    return merge.merge_counts(merge.merge_ledger(
        x.ledger.filter("left(fingerprint, 1) not in ('3', '4')"), resent_batch(x), NOW, keys=["owner_id"]), ["owner_id"])


@query("owner_id account_id:text name:text last_seen_at:text", """
    SELECT owner_id, account_id, CASE WHEN type = 'savings' THEN name || ' new' ELSE name END AS name,
        CASE WHEN type = 'savings' THEN '2001-11-05 00:00:00' END AS last_seen_at FROM accounts""")
def accounts_merge(x: Inputs) -> DataFrame:
    old = x.accounts.withColumn("last_seen_at", F.lit(None).cast("timestamp"))
    batch = x.accounts.filter("type = 'savings'").withColumn("name", F.concat("name", F.lit(" new")))
    return merge.merge_accounts(old, batch, NOW, ["owner_id"])


# --- exports -----------------------------------------------------------------------------

@query("owner_id posted_at:text direction:text amount_usd:text abs_amount_usd:text payee_norm:text merchant:text", f"""
    SELECT owner_id, posted_at, CASE WHEN amount_cents < 0 THEN 'outflow' WHEN amount_cents > 0 THEN 'inflow' ELSE 'zero' END AS direction,
        CAST(amount_cents / 100.0 AS DECIMAL(18, 2)) AS amount_usd, CAST(abs(amount_cents) / 100.0 AS DECIMAL(18, 2)) AS abs_amount_usd, merchant_norm AS payee_norm, merchant
    FROM norm WHERE posted_at BETWEEN {k.AS_OF} - 400 AND {k.AS_OF}""")
def export_transactions(x: Inputs) -> DataFrame:
    return exports.transactions(x.ledger, x.as_of)


@query("owner_id payee_norm:text monthly_est_cents status:text note:text handled_at:text", f"""
    SELECT s.owner_id, label AS payee_norm, monthly_est_cents, coalesce(status, '') AS status, CASE WHEN note LIKE '=%' THEN '''' || note ELSE coalesce(note, '') END AS note,
        coalesce(CAST(handled_at AS VARCHAR), '') AS handled_at FROM ({STRICT_CHECK}) AS s LEFT JOIN watchlist w ON w.owner_id = s.owner_id AND w.payee_norm = s.label""")
def export_actions(x: Inputs) -> DataFrame:
    return exports.actions(rec.strict_candidates(x.last_400_days, x.as_of), x.rules("watchlist"))


@query("owner_id posted_at:text merchant:text amount_usd:text pattern_type:text severity:text detail:text", f"""
    SELECT owner_id, posted_at, merchant_norm AS merchant, CAST(amount_cents / 100.0 AS DECIMAL(18, 2)) AS amount_usd, pattern_type, severity, detail FROM ({FEED_TEXTS}) AS f""")
def export_alerts(x: Inputs) -> DataFrame:
    return exports.alerts(alert_feed(x.charges, x.patterns))


@query("owner_id group_type:text merchants:text monthly_total_usd:text severity:text detail:text", f"""
    SELECT owner_id, group_type, array_to_string(names, '; ') AS merchants, CAST(total_monthly_cents / 100.0 AS DECIMAL(18, 2)) AS monthly_total_usd, severity, detail FROM ({ALL_GROUPS}) AS g""")
def export_duplicates(x: Inputs) -> DataFrame:
    kept = kept_members(group_members(x.patterns))
    return exports.duplicates(group_summary(kept), kept)


@query("owner_id merchant:text monthly_usd:text cadence:text is_duplicate:text", f"""
    WITH named AS (SELECT DISTINCT owner_id, unnest(names) AS merchant_norm FROM ({ALL_GROUPS}) AS g), {SUBSCRIBED},
    every AS (SELECT owner_id, merchant_norm, monthly_cents, cadence FROM first
        UNION ALL SELECT owner_id, merchant_norm, CASE cadence WHEN 'annual' THEN cents // 12 WHEN 'quarterly' THEN cents // 3 ELSE cents END, cadence FROM second)
    SELECT e.owner_id, e.merchant_norm AS merchant, CAST(monthly_cents / 100.0 AS DECIMAL(18, 2)) AS monthly_usd, cadence, CASE WHEN n.owner_id IS NULL THEN 'no' ELSE 'yes' END AS is_duplicate
    FROM every e LEFT JOIN named n ON n.owner_id = e.owner_id AND n.merchant_norm = e.merchant_norm""")
def export_subscriptions(x: Inputs) -> DataFrame:
    members = kept_members(group_members(x.patterns))
    return exports.subscriptions(rec.subscriptions(x.last_400_days, x.as_of, patterns=x.patterns, duplicate_members=members))


@query("owner_id period:text start_date:text end_date:text income_usd:text net_usd:text income_trend:text", f"""
    WITH t AS (SELECT * FROM ({trends_check("(SELECT * FROM reports WHERE period_start BETWEEN DATE '2001-07-01' AND DATE '2001-09-01')")}) AS t)
    SELECT r.owner_id, strftime(r.period_start, '%b %Y') AS period, r.period_start AS start_date, CAST(r.period_start + INTERVAL 1 MONTH AS DATE) AS end_date,
        CAST(CAST(r.income_cents / 100.0 AS DECIMAL(18, 2)) AS VARCHAR) AS income_usd, CAST(CAST(r.net_cents / 100.0 AS DECIMAL(18, 2)) AS VARCHAR) AS net_usd, income_trend
    FROM recent r JOIN t ON t.owner_id = r.owner_id AND t.period_start = r.period_start""".replace("FROM recent r", "FROM (SELECT * FROM reports WHERE period_start BETWEEN DATE '2001-07-01' AND DATE '2001-09-01') r"))
def export_period_summary(x: Inputs) -> DataFrame:
    return exports.period_summary(pr.period_trends(pr.period_view(_reports(x))))


@query("owner_id date:text merchant:text amount_usd:text type:text category:text account:text reason:text", """
    SELECT c.owner_id, posted_at AS date, coalesce(nullif(merchant_norm, ''), 'Unknown') AS merchant, CAST(amount_cents / 100.0 AS DECIMAL(18, 2)) AS amount_usd, txn_type AS type,
        coalesce(category_id, '') AS category, a.name AS account, reason_code AS reason FROM classified c JOIN accounts a USING (account_id) WHERE category_id = 'dining'""")
def export_drill_down(x: Inputs) -> DataFrame:
    return exports.drill_down(pr.drill_down(x.classified, "category:dining"), x.accounts)
