"""Queries: scans, classification, period reports, categories, drill-down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, labels, money, text
from ..lexicon.categories import CATEGORIES, NOT_SPENDING, REFUNDABLE
from ..operators import classify as c
from ..operators import scan
from ..operators.pairing import transfer_pairs
from ..operators import recurring as rec
from ..operators.recurring import bills
from ..operators.refunds import period_refund_matches
from ..plans import dashboard, month_tools
from ..plans import period_report as pr
from ..session import store
from . import check_sql as k
from .recurrence import SUBSCRIBED
from .matching import MONTH_LEGS, MONTH_PAIRS, MONTH_REFUNDS
from .registry import REPORTED, Inputs, query

MONTH = "period_start:text"
TEN = "income_cents discretionary_cents refunds_cents credits_other_cents transfers_in_cents transfers_out_cents"


# --- scans and scalar functions ---------------------------------------------------

@query("owner_id fingerprint:text posted_at:text amount_cents merchant_norm:text", """
    SELECT owner_id, fingerprint, posted_at, amount_cents, merchant_norm FROM posted
    WHERE posted_at >= DATE '2001-01-01' AND posted_at < DATE '2001-04-01'""")
def ledger_period_scan(x: Inputs) -> DataFrame:
    return scan.period_scan(x.ledger, "2001-01-01", "2001-04-01")


HITS = f"""SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY posted_at DESC, fingerprint) AS hit_rank,
        ends_with(account_id, '-1') AS in_selection FROM norm
        WHERE (contains(lower(coalesce(merchant, '')), 'netflix') OR contains(lower(coalesce(description, '')), 'netflix'))
        AND posted_at BETWEEN {k.AS_OF} - 400 AND {k.AS_OF}"""


def _search(x: Inputs) -> DataFrame:
    return scan.search(x.ledger, x.accounts, "Netflix", x.as_of, days=400, selected=F.endswith("account_id", F.lit("-1")), limit=15)


@query("owner_id selected_count other_count truncated:flag", f"""
    SELECT owner_id, count(CASE WHEN in_selection THEN 1 END) AS selected_count, count(CASE WHEN NOT in_selection THEN 1 END) AS other_count,
        count(*) > 15 AS truncated FROM ({HITS}) AS hits GROUP BY owner_id""")
def transaction_search(x: Inputs) -> DataFrame:
    return scan.search_summary(_search(x), limit=15)


@query("owner_id hit_rank fingerprint:text posted_at:text amount_cents account_name:text in_selection:flag", f"""
    SELECT h.owner_id, hit_rank, fingerprint, posted_at, amount_cents, a.name AS account_name, in_selection
    FROM ({HITS}) AS h LEFT JOIN accounts a USING (account_id) WHERE hit_rank <= 15""")
def transaction_search_rows(x: Inputs) -> DataFrame:
    return _search(x)


@query("owner_id fingerprint:text fuzzy:text label:text described:text words:text week:text quarter:text usd:text compact:text half tenth close:flag",
       """
    SELECT owner_id, fingerprint,
        trim(regexp_replace(regexp_replace(regexp_replace(split_part(merchant_norm, '*', 1),
            '\\s*(\\.com|\\.net|\\.org|inc\\.?|llc\\.?|ltd\\.?|corp\\.?|\\*+)$', ''), '\\s+\\d{4,}$', ''), '\\s+', ' ', 'g')) AS fuzzy,
        coalesce(nullif(merchant, ''), nullif(description, '')) AS label, coalesce(description, merchant, '') AS described,
        upper(trim(regexp_replace(coalesce(merchant, ''), '\\s+', ' ', 'g'))) AS words,
        strftime(posted_at, '%Y-%W') AS week, 'Q' || quarter(posted_at) || ' ' || year(posted_at) AS quarter,
        (CASE WHEN amount_cents < 0 THEN '-' ELSE '' END) || '$' || format('{:,.2f}', abs(amount_cents) / 100.0) AS usd,
        (CASE WHEN amount_cents < 0 THEN '-' ELSE '' END) || '$' || CASE WHEN amount_cents % 100 = 0
            THEN format('{:,}', abs(amount_cents) // 100) ELSE format('{:,.2f}', abs(amount_cents) / 100.0) END AS compact,
        round(CAST(amount_cents AS DECIMAL(18, 2)) / 2) AS half, round(CAST(amount_cents AS DECIMAL(18, 2)) * 15 / 100) AS tenth,
        abs(amount_cents + 50000) <= 2000 OR abs(amount_cents + 50000) * 100.0 / greatest(abs(amount_cents), 50000, 1) <= 5 AS close
    FROM norm""")
def text_and_money_functions(x: Inputs) -> DataFrame:
    cents = F.col("amount_cents")
    return scan.with_merchant_norm(x.ledger).select(
        "owner_id", "fingerprint", text.fuzzy_key(F.col("merchant_norm")).alias("fuzzy"),
        text.raw_label(F.col("merchant"), F.col("description")).alias("label"),
        text.raw_description(F.col("merchant"), F.col("description")).alias("described"),
        text.norm_text(F.col("merchant")).alias("words"), dates.monday_week_key(F.col("posted_at")).alias("week"),
        dates.period_label(dates.period_start(F.col("posted_at"), "quarter"), "quarter").alias("quarter"),
        money.format_usd(cents).alias("usd"), money.format_usd_compact(cents).alias("compact"),
        money.divide_cents(cents, 2).alias("half"), money.percent_of(cents, 15).alias("tenth"),
        money.within_threshold(cents, F.lit(-50000), 2000, 5.0).alias("close"))


# --- classification ------------------------------------------------------------------

@query("owner_id fingerprint:text txn_type:text reason_code:text confidence:real category_id:text",
       "SELECT owner_id, fingerprint, txn_type, reason_code, confidence, category_id FROM classified")
def classified_rows(x: Inputs) -> DataFrame:
    return x.classified


@query("owner_id fingerprint:text txn_type:text reason_code:text", """
    WITH exact AS (SELECT owner_id, fingerprint, target_type FROM type_overrides WHERE fingerprint IS NOT NULL),
    pats AS (SELECT t.owner_id, t.merchant_norm, arg_min(o.target_type, o.rule_order) AS target_type
        FROM (SELECT DISTINCT owner_id, merchant_norm FROM typed) t JOIN type_overrides o ON o.owner_id = t.owner_id
        AND o.fingerprint IS NULL AND contains(t.merchant_norm, lower(o.merchant_pattern)) GROUP BY 1, 2),
    hints AS (SELECT t.owner_id, t.merchant_norm, min(r.rule_type) AS hint FROM (SELECT DISTINCT owner_id, merchant_norm FROM typed) t
        JOIN merchant_rules r ON r.owner_id = t.owner_id AND r.rule_type IN ('income', 'not_income')
        AND contains(t.merchant_norm, lower(r.merchant_pattern)) GROUP BY 1, 2)
    SELECT t.owner_id, t.fingerprint,
        CASE WHEN e.target_type IS NOT NULL THEN e.target_type WHEN p.target_type IS NOT NULL THEN p.target_type
            WHEN amount_cents > 0 AND hint = 'not_income' THEN 'CREDIT_OTHER' WHEN amount_cents > 0 AND hint = 'income' THEN 'INCOME'
            ELSE txn_type END AS txn_type,
        CASE WHEN e.target_type IS NOT NULL OR p.target_type IS NOT NULL THEN 'USER_OVERRIDE'
            WHEN amount_cents > 0 AND hint = 'not_income' THEN 'USER_NOT_INCOME_RULE' WHEN amount_cents > 0 AND hint = 'income' THEN 'USER_INCOME_RULE'
            ELSE reason_code END AS reason_code
    FROM typed t LEFT JOIN exact e USING (owner_id, fingerprint) LEFT JOIN pats p ON p.owner_id = t.owner_id AND p.merchant_norm = t.merchant_norm
    LEFT JOIN hints h ON h.owner_id = t.owner_id AND h.merchant_norm = t.merchant_norm""", read=REPORTED)
def classified_with_overrides(x: Inputs) -> DataFrame:
    return pr.classified_ledger(x.ledger, x.accounts, type_overrides=x.rules("type_overrides"),
                                merchant_rules=x.rules("merchant_rules"), with_categories=False)


@query("owner_id fingerprint:text spending_bucket:text txn_type:text", """
    SELECT t.owner_id, t.fingerprint,
        CASE WHEN p.is_transfer AND reason_code <> 'TRANSFER_CC_PAYMENT' THEN 'TRANSFER' ELSE txn_type END AS txn_type,
        CASE WHEN txn_type <> 'EXPENSE' OR p.is_transfer THEN NULL
            WHEN p.is_recurring AND cadence IN ('weekly', 'monthly', 'annual', 'biweekly', 'quarterly') THEN 'FIXED_OBLIGATIONS'
            WHEN p.is_habitual THEN 'VARIABLE_ESSENTIALS' ELSE 'DISCRETIONARY' END AS spending_bucket
    FROM typed t LEFT JOIN patterns p ON p.owner_id = t.owner_id AND p.merchant_norm = t.merchant_norm
    WHERE amount_cents <= 0""")
def spending_buckets(x: Inputs) -> DataFrame:
    patterns = x.patterns
    rows = pr.classified_ledger(x.ledger, x.accounts, patterns=patterns, with_categories=False)
    return rows.filter("amount_cents <= 0")


@query("owner_id fingerprint:text label:text", "SELECT owner_id, fingerprint, label FROM five")
def five_labels(x: Inputs) -> DataFrame:
    return c.five_label(c.with_card_flag(scan.with_merchant_norm(x.posted), x.accounts))


@query("owner_id merchant_norm:text family:text subtype:text noise:flag display_name:text", f"""
    SELECT DISTINCT owner_id, merchant_norm,
        CASE WHEN {k.has_any('merchant_norm', ['amazon', 'prime'])} THEN 'amazon' WHEN {k.has_any('merchant_norm', ['youtube', 'google'])} THEN 'google'
            WHEN {k.has_any('merchant_norm', ['disney', 'hulu', 'espn'])} THEN 'disney_bundle' ELSE 'other' END AS family,
        CASE WHEN {k.has_any('merchant_norm', ['amazon', 'prime'])} THEN CASE WHEN contains(merchant_norm, 'tip') THEN 'tip'
                WHEN contains(merchant_norm, 'prime video') THEN 'prime_video' WHEN contains(merchant_norm, 'prime') THEN 'prime' ELSE 'amazon_misc' END
            WHEN {k.has_any('merchant_norm', ['youtube', 'google'])} THEN CASE WHEN contains(merchant_norm, 'fiber') THEN 'fiber'
                WHEN contains(merchant_norm, 'premium') THEN 'youtube_premium' WHEN contains(merchant_norm, 'member') THEN 'youtube_membership'
                WHEN contains(merchant_norm, 'youtube') THEN 'youtube_misc' ELSE 'google_misc' END
            WHEN contains(merchant_norm, 'disney') AND contains(merchant_norm, 'hulu') THEN 'bundle' WHEN contains(merchant_norm, 'disney') THEN 'disney'
            WHEN contains(merchant_norm, 'hulu') THEN 'hulu' WHEN contains(merchant_norm, 'espn') THEN 'espn' ELSE 'other' END AS subtype,
        {k.has_any('merchant_norm', k.kw.NOISE)} AS noise, {k.service('merchant_norm')} AS display_name
    FROM norm""")
def vendor_labels(x: Inputs) -> DataFrame:
    family = c.vendor_family(F.col("merchant_norm"))
    return c.with_service(scan.with_merchant_norm(x.ledger).select("owner_id", "merchant_norm").distinct()).select(
        "owner_id", "merchant_norm", family["family"].alias("family"), family["subtype"].alias("subtype"),
        c.is_noise(F.col("merchant_norm")).alias("noise"),
        F.col("service.display_name").alias("display_name"))


@query("owner_id account_id:text by_type:flag by_name:flag", f"""
    SELECT owner_id, account_id, contains(lower(type), 'credit') AS by_type,
        NOT {k.has_any('lower(name)', k.kw.NOT_CARD_NAME)} AND {k.has_any('lower(name)', k.kw.CARD_NAME)} AS by_name FROM accounts""")
def card_accounts(x: Inputs) -> DataFrame:
    return x.accounts.withColumn("by_type", c.is_card_type(F.col("type"))).withColumn("by_name", c.is_card_name(F.col("name")))


@query("owner_id expense_only:flag",
       "SELECT owner_id, bool_and(contains(lower(type), 'credit')) AS expense_only FROM accounts WHERE (owner_id + CAST(right(account_id, 1) AS INT)) % 2 = 1 GROUP BY owner_id")
def expense_only_ledgers(x: Inputs) -> DataFrame:
    chosen = x.accounts.filter((F.col("owner_id") + F.substring("account_id", -1, 1).cast("int")) % 2 == 1)
    return c.expense_only_view(chosen)


# --- period reports --------------------------------------------------------------------

@query(f"owner_id {MONTH} {TEN} transaction_count unclassified_credit_count net_cents net_spend_cents transfer_balance_cents", """
    SELECT *, income_cents + refunds_cents - discretionary_cents AS net_cents, discretionary_cents - refunds_cents AS net_spend_cents,
        transfers_in_cents - transfers_out_cents AS transfer_balance_cents FROM totals""")
def period_totals(x: Inputs) -> DataFrame:
    return pr.period_totals(x.typed)


@query("owner_id period_start:text income_cents discretionary_cents net_cents", """
    SELECT owner_id, CAST(date_trunc('quarter', posted_at) AS DATE) AS period_start,
        sum(CASE WHEN txn_type = 'INCOME' THEN amount_cents ELSE 0 END) AS income_cents,
        sum(CASE WHEN txn_type = 'EXPENSE' THEN -amount_cents ELSE 0 END) AS discretionary_cents,
        sum(CASE WHEN txn_type IN ('INCOME', 'REFUND', 'EXPENSE') THEN amount_cents ELSE 0 END) AS net_cents FROM typed GROUP BY 1, 2""")
def quarter_totals(x: Inputs) -> DataFrame:
    return pr.period_totals(x.typed, "quarter")


@query("owner_id income_cents net_cents transaction_count", """
    SELECT owner_id, sum(CASE WHEN txn_type = 'INCOME' THEN amount_cents ELSE 0 END) AS income_cents,
        sum(CASE WHEN txn_type IN ('INCOME', 'REFUND', 'EXPENSE') THEN amount_cents ELSE 0 END) AS net_cents, count(*) AS transaction_count
    FROM typed WHERE posted_at >= DATE '2001-02-10' AND posted_at < DATE '2001-08-21' GROUP BY owner_id""")
def custom_range_totals(x: Inputs) -> DataFrame:
    return pr.range_totals(x.typed, "2001-02-10", "2001-08-21")


def _reports(x: Inputs, months: int = 6) -> DataFrame:
    return pr.period_reports(pr.period_totals(x.typed_months(months)), x.accounts, x.as_of, months)


@query(f"owner_id {MONTH} period_label:text {TEN} transaction_count", """
    SELECT *, strftime(period_start, '%b %Y') AS period_label FROM reports""")
def monthly_reports(x: Inputs) -> DataFrame:
    return _reports(x)


@query(f"owner_id {MONTH} recurring_cents discretionary_cents credit_cents transfer_cents net_cents", """
    SELECT owner_id, period_start, 0 AS recurring_cents, discretionary_cents, refunds_cents + credits_other_cents AS credit_cents,
        transfers_in_cents + transfers_out_cents AS transfer_cents, net_cents FROM reports""")
def period_views(x: Inputs) -> DataFrame:
    return pr.period_view(_reports(x))


def trends_check(reports: str) -> str:
    return f"""
    WITH w AS (SELECT owner_id, period_start, income_cents, discretionary_cents,
        sum(income_cents) OVER r // count(*) OVER r AS avg_income_cents, sum(discretionary_cents) OVER r // count(*) OVER r AS avg_discretionary_cents,
        lag(income_cents) OVER o AS prev_income_cents, lag(discretionary_cents) OVER o AS prev_discretionary FROM {reports} AS p
        WINDOW o AS (PARTITION BY owner_id ORDER BY period_start), r AS (PARTITION BY owner_id ORDER BY period_start ROWS 2 PRECEDING))
    SELECT *, CASE WHEN prev_income_cents IS NULL THEN 'stable' WHEN prev_income_cents = 0 THEN CASE WHEN income_cents = 0 THEN 'stable' ELSE 'up' END
        WHEN (income_cents - prev_income_cents) / CAST(abs(prev_income_cents) AS DOUBLE) > 0.05 THEN 'up'
        WHEN (income_cents - prev_income_cents) / CAST(abs(prev_income_cents) AS DOUBLE) < -0.05 THEN 'down' ELSE 'stable' END AS income_trend,
        CASE WHEN prev_discretionary IS NULL THEN 'stable' WHEN prev_discretionary = 0 THEN CASE WHEN discretionary_cents = 0 THEN 'stable' ELSE 'up' END
        WHEN (discretionary_cents - prev_discretionary) / CAST(abs(prev_discretionary) AS DOUBLE) > 0.05 THEN 'up'
        WHEN (discretionary_cents - prev_discretionary) / CAST(abs(prev_discretionary) AS DOUBLE) < -0.05 THEN 'down' ELSE 'stable' END AS discretionary_trend
    FROM w"""


@query(f"owner_id {MONTH} avg_income_cents avg_discretionary_cents prev_income_cents income_trend:text discretionary_trend:text", trends_check("reports"))
def period_trends(x: Inputs) -> DataFrame:
    return pr.period_trends(pr.period_view(_reports(x)))


FULL = f"""WITH legs AS MATERIALIZED {MONTH_LEGS}, refunded AS MATERIALIZED {MONTH_REFUNDS},
    exact AS (SELECT owner_id, fingerprint, target_type FROM type_overrides WHERE fingerprint IS NOT NULL),
    merchants AS (SELECT DISTINCT owner_id, merchant_norm FROM typed),
    pats AS (SELECT t.owner_id, t.merchant_norm, arg_min(o.target_type, o.rule_order) AS target_type FROM merchants t JOIN type_overrides o ON o.owner_id = t.owner_id
        AND o.fingerprint IS NULL AND contains(t.merchant_norm, lower(o.merchant_pattern)) GROUP BY 1, 2),
    hints AS (SELECT t.owner_id, t.merchant_norm, min(r.rule_type) AS hint FROM merchants t JOIN merchant_rules r ON r.owner_id = t.owner_id
        AND r.rule_type IN ('income', 'not_income') AND contains(t.merchant_norm, lower(r.merchant_pattern)) GROUP BY 1, 2),
    judged AS (SELECT t.*, coalesce(e.target_type, o.target_type) AS set_type, l.fingerprint IS NOT NULL AS paired, q.is_recurring, q.is_habitual, q.cadence,
        CASE WHEN e.target_type IS NOT NULL THEN e.target_type WHEN o.target_type IS NOT NULL THEN o.target_type WHEN l.fingerprint IS NOT NULL THEN 'TRANSFER'
            WHEN r.fingerprint IS NOT NULL AND amount_cents > 0 THEN 'REFUND' WHEN amount_cents > 0 AND hint = 'not_income' THEN 'CREDIT_OTHER'
            WHEN amount_cents > 0 AND hint = 'income' THEN 'INCOME' WHEN amount_cents <= 0 AND reason_code = 'TRANSFER_CC_PAYMENT' THEN 'TRANSFER'
            WHEN q.is_transfer THEN 'TRANSFER' ELSE txn_type END AS kind
        FROM typed t LEFT JOIN exact e ON e.owner_id = t.owner_id AND e.fingerprint = t.fingerprint
        LEFT JOIN pats o ON o.owner_id = t.owner_id AND o.merchant_norm = t.merchant_norm LEFT JOIN hints h ON h.owner_id = t.owner_id AND h.merchant_norm = t.merchant_norm
        LEFT JOIN legs l ON l.owner_id = t.owner_id AND l.fingerprint = t.fingerprint LEFT JOIN refunded r ON r.owner_id = t.owner_id AND r.fingerprint = t.fingerprint
        LEFT JOIN patterns q ON q.owner_id = t.owner_id AND q.merchant_norm = t.merchant_norm),
    bucketed AS (SELECT *, CASE WHEN kind <> 'EXPENSE' THEN '' WHEN set_type IS NOT NULL THEN 'other'
        WHEN is_recurring AND cadence IN ('weekly', 'monthly', 'annual', 'biweekly', 'quarterly') THEN 'fixed' WHEN is_habitual THEN 'variable' ELSE 'other' END AS bucket FROM judged)"""


@query(f"owner_id {MONTH} {TEN} fixed_obligations_cents variable_essentials_cents transaction_count net_cents", FULL + """
    SELECT *, income_cents + refunds_cents - fixed_obligations_cents - variable_essentials_cents - discretionary_cents AS net_cents FROM (
        SELECT owner_id, month AS period_start, sum(CASE WHEN kind = 'INCOME' THEN amount_cents ELSE 0 END) AS income_cents,
            sum(CASE WHEN bucket = 'fixed' THEN abs(amount_cents) ELSE 0 END) AS fixed_obligations_cents,
            sum(CASE WHEN bucket = 'variable' THEN abs(amount_cents) ELSE 0 END) AS variable_essentials_cents,
            sum(CASE WHEN bucket = 'other' THEN abs(amount_cents) ELSE 0 END) AS discretionary_cents,
            sum(CASE WHEN kind = 'REFUND' THEN amount_cents ELSE 0 END) AS refunds_cents, sum(CASE WHEN kind = 'CREDIT_OTHER' THEN amount_cents ELSE 0 END) AS credits_other_cents,
            sum(CASE WHEN kind = 'TRANSFER' AND amount_cents > 0 THEN amount_cents ELSE 0 END) AS transfers_in_cents,
            sum(CASE WHEN kind = 'TRANSFER' AND amount_cents <= 0 THEN -amount_cents ELSE 0 END) AS transfers_out_cents, count(*) AS transaction_count
        FROM bucketed GROUP BY owner_id, month) AS sums""", read=REPORTED)
def full_period_report(x: Inputs) -> DataFrame:
    """Every input of the report: pairs and refunds per period, patterns, overrides, rules."""
    return pr.period_totals(full_rows(x))


@query("owner_id fingerprint:text txn_type:text bucket:text paired:flag", FULL + """
    SELECT owner_id, fingerprint, kind AS txn_type, CASE WHEN kind = 'EXPENSE' AND set_type IS NULL THEN bucket END AS bucket, paired FROM bucketed""", read=REPORTED)
def fully_classified_rows(x: Inputs) -> DataFrame:
    """The rows behind the full report."""
    names = {c.FIXED: "fixed", c.VARIABLE: "variable", c.DISCRETIONARY: "other"}
    bucket = F.coalesce(*[F.when(F.col("spending_bucket") == name, F.lit(short)) for name, short in names.items()])
    return full_rows(x).withColumn("bucket", bucket).withColumn("paired", F.coalesce("is_paired", F.lit(False)))


def full_rows(x: Inputs, ledger: DataFrame | None = None) -> DataFrame:
    """Rows of the stored ledger, or of a stored cut of it, with all that the full report reads.

    Pairs and refunds are stored: few rows, whose shuffles are freed before those of the ledger's own rows begin."""
    patterns = x.stored_patterns if ledger is None else x.patterns
    ledger = x.stored if ledger is None else ledger
    keyed = ledger.withColumn("period_start", dates.period_start(F.col("posted_at")))
    pairs = store(transfer_pairs(keyed, keys=("owner_id", "period_start"), stored=True).drop("period_start"))
    refunds = store(period_refund_matches(ledger, stored=True).drop("period_start"))
    return pr.classified_ledger(
        ledger, x.accounts, pairs=pairs, refunds=refunds, patterns=patterns,
        type_overrides=x.rules("type_overrides", ledger), merchant_rules=x.rules("merchant_rules"), with_categories=False)


@query("owner_id period_start:text section:text merchant:text total_cents row_count", """
    SELECT owner_id, month AS period_start, CASE txn_type WHEN 'INCOME' THEN 'income' WHEN 'TRANSFER' THEN 'transfer' WHEN 'EXPENSE' THEN 'one_off' ELSE 'credit' END AS section,
        coalesce(nullif(merchant_norm, ''), 'Unknown') AS merchant,
        sum(CASE WHEN txn_type IN ('TRANSFER', 'EXPENSE') THEN abs(amount_cents) ELSE amount_cents END) AS total_cents, count(*) AS row_count
    FROM typed GROUP BY 1, 2, 3, 4""")
def month_summary_by_merchant(x: Inputs) -> DataFrame:
    return pr.merchant_summary(x.typed)


@query("owner_id period_start:text baseline_cents net_cents verdict:text tier:text", """
    SELECT owner_id, period_start, income_cents AS baseline_cents, income_cents - discretionary_cents AS net_cents,
        CASE WHEN income_cents - discretionary_cents < 0 THEN 'dipped_into_savings' WHEN income_cents > 0 THEN 'on_track' ELSE 'break_even' END AS verdict,
        CASE WHEN income_cents <= 0 THEN 'negative' WHEN (income_cents - discretionary_cents) * 100.0 / income_cents >= 30 THEN 'wealth-building'
            WHEN (income_cents - discretionary_cents) * 100.0 / income_cents >= 20 THEN 'progress'
            WHEN income_cents > discretionary_cents THEN 'survival' ELSE 'negative' END AS tier FROM totals""")
def month_verdicts(x: Inputs) -> DataFrame:
    rate = F.when(F.col("income_cents") > 0, F.col("net_cents") * 100 / F.col("income_cents")).otherwise(F.lit(0.0))
    return pr.month_summary(pr.period_totals(x.typed)).withColumn("tier", labels.savings_tier(rate))


@query("owner_id period_start:text income_cents credit_cents discretionary_cents net_cents savings_rate:real health:text checksum_valid:flag", """
    WITH s AS (SELECT owner_id, CAST(date_trunc('month', posted_at) AS DATE) AS period_start,
        sum(CASE WHEN label = 'income' THEN amount_cents ELSE 0 END) AS income_cents, sum(CASE WHEN label = 'credit' THEN amount_cents ELSE 0 END) AS credit_cents,
        sum(CASE WHEN label = 'one-off' THEN -amount_cents ELSE 0 END) AS discretionary_cents FROM five GROUP BY 1, 2),
    n AS (SELECT *, income_cents + credit_cents - discretionary_cents AS net_cents FROM s)
    SELECT *, CASE WHEN income_cents > 0 THEN net_cents / CAST(income_cents AS DOUBLE) ELSE 0 END AS savings_rate,
        CASE WHEN income_cents <= 0 THEN 'no_income' WHEN net_cents / CAST(income_cents AS DOUBLE) >= 0.15 THEN 'positive'
            WHEN net_cents / CAST(income_cents AS DOUBLE) >= -0.05 THEN 'breakeven' ELSE 'negative' END AS health, TRUE AS checksum_valid FROM n""")
def five_label_analysis(x: Inputs) -> DataFrame:
    rows = c.five_label(c.with_card_flag(scan.with_merchant_norm(x.posted), x.accounts))
    return pr.five_label_periods(rows)


@query("owner_id period_start:text pending_count", """
    SELECT owner_id, CAST(date_trunc('month', posted_at) AS DATE) AS period_start, count(*) AS pending_count FROM norm WHERE pending GROUP BY 1, 2""")
def pending_counts(x: Inputs) -> DataFrame:
    return pr.pending_counts(x.ledger)


@query("owner_id period_start:text flags:text score:real is_actionable:flag badge:text", """
    SELECT owner_id, period_start, CASE WHEN unclassified_credit_count > 0 THEN '["UNCLASSIFIED_CREDIT"]' ELSE '[]' END AS flags,
        CASE WHEN unclassified_credit_count > 0 THEN 0.9 ELSE 1.0 END AS score, TRUE AS is_actionable,
        CASE WHEN unclassified_credit_count > 0 THEN 'Good' ELSE 'Excellent' END AS badge FROM totals""")
def integrity_scores(x: Inputs) -> DataFrame:
    return pr.integrity(pr.period_totals(x.typed)).withColumn("flags", F.to_json("flags"))


@query("owner_id period_start:text task_type:text priority affected_cents priority_label:text", FULL + """,
    credits AS (SELECT owner_id, month, sum(amount_cents) AS cents FROM bucketed WHERE kind = 'CREDIT_OTHER' GROUP BY 1, 2),
    loose AS (SELECT owner_id, month FROM bucketed WHERE amount_cents <> 0 AND NOT paired GROUP BY 1, 2)
    SELECT owner_id, month AS period_start, 'CLASSIFY_CREDIT' AS task_type, 1 AS priority, cents AS affected_cents, 'Critical' AS priority_label FROM credits
    UNION ALL SELECT owner_id, month, 'MATCH_TRANSFER', 2, 0, 'High' FROM loose""", read=REPORTED)
def resolution_tasks(x: Inputs) -> DataFrame:
    """Of the full report, with unmatched legs counted."""
    month = ["owner_id", "period_start"]
    rows = store(full_rows(x).select(
        "owner_id", "posted_at", dates.period_start(F.col("posted_at")).alias("period_start"), "amount_cents", "txn_type", "spending_bucket", "is_paired"))
    counts = rows.filter("amount_cents <> 0 and is_paired is null").groupBy(*month).agg(F.count("*").alias("unmatched_transfer_count"))
    return pr.resolution_tasks(pr.integrity(pr.period_totals(rows).join(counts, month, "left")))


_IN_SCOPE = {
    "income": ("kind = 'INCOME'", "amount_cents"), "spend": ("kind IN ('EXPENSE', 'REFUND')", "CASE WHEN kind = 'REFUND' THEN -amount_cents ELSE abs(amount_cents) END"),
    "recurring": ("bucket = 'fixed'", "abs(amount_cents)"), "discretionary": ("bucket = 'variable' OR (bucket = 'other' AND set_type IS NULL)", "abs(amount_cents)"),
    "net": ("kind NOT IN ('TRANSFER', 'CREDIT_OTHER')", "CASE WHEN kind = 'EXPENSE' THEN -abs(amount_cents) ELSE amount_cents END"),
    "credit_other": ("kind = 'CREDIT_OTHER'", "amount_cents"), "unmatched_transfers": ("kind = 'TRANSFER' AND NOT paired", "amount_cents"),
    "transfer": ("kind = 'TRANSFER'", "abs(amount_cents)"), "merchant:netflix.com": ("merchant_norm = 'netflix.com'", "abs(amount_cents)"),
}


@query("owner_id period_start:text scope:text row_count scope_total_cents excluded_transfer_count excluded_credit_count", FULL + " UNION ALL ".join(f"""
    SELECT owner_id, month AS period_start, '{name}' AS scope, count(CASE WHEN {inside} THEN 1 END) AS row_count, sum(CASE WHEN {inside} THEN {value} ELSE 0 END) AS scope_total_cents,
        count(CASE WHEN NOT ({inside}) AND kind = 'TRANSFER' THEN 1 END) AS excluded_transfer_count,
        count(CASE WHEN NOT ({inside}) AND kind = 'CREDIT_OTHER' THEN 1 END) AS excluded_credit_count FROM bucketed GROUP BY 1, 2""" for name, (inside, value) in _IN_SCOPE.items()), read=REPORTED)
def drill_down_scopes(x: Inputs) -> DataFrame:
    """Every scope of the full report."""
    return pr.drill_down_table(full_rows(x), list(_IN_SCOPE))


# --- an account filter from rows to flags ---------------------------------------------------

_CHOSEN = "NOT ends_with({}, '-2')"
_FILTERED = f"""WITH shown AS MATERIALIZED ({MONTH_PAIRS} SELECT CAST(split_part(owner_id, '#', 1) AS BIGINT) AS owner_id, first_fp, second_fp FROM pairs
        WHERE {_CHOSEN.format('out_account_id')} AND {_CHOSEN.format('in_account_id')}),
    ends AS (SELECT owner_id, first_fp AS fingerprint FROM shown UNION SELECT owner_id, second_fp FROM shown),
    filtered AS (SELECT t.*, CASE WHEN e.fingerprint IS NOT NULL THEN 'TRANSFER' ELSE txn_type END AS kind FROM typed t
        LEFT JOIN ends e ON e.owner_id = t.owner_id AND e.fingerprint = t.fingerprint WHERE {_CHOSEN.format('account_id')})"""


def _chosen(accounts: DataFrame) -> DataFrame:
    return accounts.filter("not endswith(account_id, '-2')").select("account_id")


def _filtered_rows(x: Inputs) -> DataFrame:
    keyed = x.stored.withColumn("period_start", dates.period_start(F.col("posted_at")))
    pairs = transfer_pairs(keyed, keys=("owner_id", "period_start"), stored=True).drop("period_start")
    return pr.classified_ledger(x.stored, x.accounts, pairs=pairs, accounts=_chosen(x.accounts), with_categories=False)


@query(f"owner_id {MONTH} income_cents discretionary_cents transfers_in_cents transfers_out_cents transaction_count flags:text", _FILTERED + """
    SELECT owner_id, month AS period_start, sum(CASE WHEN kind = 'INCOME' THEN amount_cents ELSE 0 END) AS income_cents,
        sum(CASE WHEN kind = 'EXPENSE' THEN abs(amount_cents) ELSE 0 END) AS discretionary_cents,
        sum(CASE WHEN kind = 'TRANSFER' AND amount_cents > 0 THEN amount_cents ELSE 0 END) AS transfers_in_cents,
        sum(CASE WHEN kind = 'TRANSFER' AND amount_cents <= 0 THEN -amount_cents ELSE 0 END) AS transfers_out_cents, count(*) AS transaction_count,
        CASE WHEN max(CASE WHEN kind = 'CREDIT_OTHER' THEN 1 ELSE 0 END) = 1 THEN '["UNCLASSIFIED_CREDIT"]' ELSE '[]' END AS flags FROM filtered GROUP BY 1, 2""", read=REPORTED)
def account_filtered_report(x: Inputs) -> DataFrame:
    """Only the chosen accounts; a pair with a leg elsewhere is no pair here."""
    return pr.integrity(pr.period_totals(_filtered_rows(x)), _chosen(x.all_accounts)).withColumn("flags", F.to_json("flags"))


@query("owner_id fingerprint:text amount_cents txn_type:text", _FILTERED + " SELECT owner_id, fingerprint, amount_cents, kind AS txn_type FROM filtered WHERE kind = 'TRANSFER'", read=REPORTED)
def account_filtered_transfers(x: Inputs) -> DataFrame:
    """The rows behind the transfer totals of the filtered report."""
    return _filtered_rows(x).filter(F.col("txn_type") == c.TRANSFER)


@query("owner_id period_start:text flags:text score:real transaction_count", """
    SELECT DISTINCT owner_id, DATE '2001-09-01' AS period_start, '["EMPTY_ACCOUNT_FILTER"]' AS flags, 1.0 AS score, 0 AS transaction_count FROM accounts""")
def empty_account_choice(x: Inputs) -> DataFrame:
    """Every ledger's September under a choice of no account: zeros and a flag."""
    none = x.accounts.limit(0).select("account_id")
    rows = pr.classified_ledger(x.ledger, x.accounts, accounts=none, with_categories=False)
    reports = pr.period_reports(pr.period_totals(rows), x.accounts, "2001-09-30", 1)
    return pr.integrity(reports, none).withColumn("flags", F.to_json("flags"))


# --- categories ---------------------------------------------------------------------------

@query("owner_id period_start:text category:text gross_cents refund_cents net_cents row_count", "SELECT * FROM breakdown")
def category_breakdown(x: Inputs) -> DataFrame:
    return pr.category_breakdown(x.classified)


_SCAN = f"""WITH judged AS (SELECT n.owner_id, CAST(date_trunc('month', posted_at) AS DATE) AS period_start, n.merchant_norm, amount_cents, o.category_id AS chosen,
        {k.category("lower(n.merchant_norm || ' ' || coalesce(description, ''))")} AS found
        FROM norm n LEFT JOIN category_overrides o ON o.owner_id = n.owner_id AND o.merchant_norm = n.merchant_norm),
    named AS (SELECT *, CASE WHEN chosen IN {k.names(CATEGORIES)} THEN chosen WHEN amount_cents <= 0 THEN found
        WHEN found IN {k.names(REFUNDABLE)} OR found = 'income' THEN found ELSE 'one_time_deposit' END AS category FROM judged)"""


@query("owner_id period_start:text category:text gross_cents refund_cents net_cents row_count", _SCAN + f"""
    SELECT owner_id, period_start, category, sum(CASE WHEN amount_cents < 0 THEN -amount_cents ELSE 0 END) AS gross_cents,
        sum(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END) AS refund_cents, -sum(amount_cents) AS net_cents,
        count(CASE WHEN amount_cents <> 0 THEN 1 END) AS row_count
    FROM named WHERE category NOT IN {k.names(NOT_SPENDING)} GROUP BY 1, 2, 3 HAVING gross_cents > 0 OR refund_cents > 0""")
def scanned_category_breakdown(x: Inputs) -> DataFrame:
    return pr.scan_breakdown(pr.scan_categories(x.ledger, x.rules("category_overrides")))


@query("owner_id period_start:text category:text place merchant_norm:text total_cents row_count", _SCAN + """,
    sums AS (SELECT owner_id, period_start, category, merchant_norm, sum(abs(amount_cents)) AS total_cents, count(*) AS row_count FROM named GROUP BY 1, 2, 3, 4)
    SELECT *, row_number() OVER (PARTITION BY owner_id, period_start, category ORDER BY total_cents DESC, merchant_norm) AS place FROM sums
    QUALIFY place <= 3""")
def top_merchants_by_category(x: Inputs) -> DataFrame:
    return pr.top_merchants_by_category(pr.scan_categories(x.ledger, x.rules("category_overrides")), 3)


@query("owner_id place merchant_norm:text total_cents row_count last_seen:text", """
    SELECT owner_id, merchant_norm, sum(-amount_cents) AS total_cents, count(*) AS row_count, max(posted_at) AS last_seen,
        row_number() OVER (PARTITION BY owner_id ORDER BY total_cents DESC, merchant_norm) AS place
    FROM posted WHERE amount_cents < 0 GROUP BY owner_id, merchant_norm QUALIFY place <= 20""")
def top_merchants(x: Inputs) -> DataFrame:
    return pr.top_merchants(x.ledger)


@query("owner_id merchant_norm:text status:text", f"""
    WITH {SUBSCRIBED}, top AS (SELECT owner_id, merchant_norm, sum(-amount_cents) AS total_cents,
        row_number() OVER (PARTITION BY owner_id ORDER BY total_cents DESC, merchant_norm) AS place
        FROM posted WHERE amount_cents < 0 GROUP BY owner_id, merchant_norm QUALIFY place <= 20),
    listed AS (SELECT owner_id, merchant_norm FROM first UNION SELECT owner_id, merchant_norm FROM second
        UNION SELECT owner_id, merchant_norm FROM classes WHERE is_recurring AND NOT is_transfer AND pattern_class IN ('utility', 'insurance')),
    again AS (SELECT owner_id, merchant_norm FROM patterns WHERE is_recurring)
    SELECT t.owner_id, t.merchant_norm, CASE WHEN b.merchant_norm IS NOT NULL THEN 'tracked' WHEN a.merchant_norm IS NOT NULL THEN 'recurring' ELSE 'untracked' END AS status
    FROM top t LEFT JOIN listed b USING (owner_id, merchant_norm) LEFT JOIN again a USING (owner_id, merchant_norm)""")
def merchant_tracking(x: Inputs) -> DataFrame:
    """On a subscription or bill list, recurring without being on one, or neither."""
    subs = rec.subscriptions(x.last_400_days, x.as_of, patterns=x.patterns)
    listed = subs.select("owner_id", "merchant_norm").union(bills(x.patterns).select("owner_id", "merchant_norm"))
    return pr.with_tracking(pr.top_merchants(x.ledger), listed, x.patterns.filter("is_recurring"))


_OCTOBER = "period_start = DATE '2001-10-01'"


@query("owner_id category_id:text target_cents spent_cents remaining_cents percent_used:real", f"""
    SELECT t.owner_id, t.category_id, monthly_target_cents AS target_cents, coalesce(net_cents, 0) AS spent_cents,
        monthly_target_cents - coalesce(net_cents, 0) AS remaining_cents, round(coalesce(net_cents, 0) * 100.0 / monthly_target_cents, 1) AS percent_used
    FROM budget_targets t LEFT JOIN (SELECT * FROM breakdown WHERE {_OCTOBER}) b ON b.owner_id = t.owner_id AND b.category = t.category_id""")
def budget_status(x: Inputs) -> DataFrame:
    return pr.budget_status(pr.category_breakdown(x.classified_months(2)).filter(_OCTOBER), x.rules("budget_targets"))


@query("owner_id total_budget_cents total_spent_cents total_remaining_cents total_percent_used:real", f"""
    SELECT t.owner_id, sum(monthly_target_cents) AS total_budget_cents, sum(coalesce(net_cents, 0)) AS total_spent_cents,
        sum(monthly_target_cents) - sum(coalesce(net_cents, 0)) AS total_remaining_cents,
        round(sum(coalesce(net_cents, 0)) * 100.0 / sum(monthly_target_cents), 1) AS total_percent_used
    FROM budget_targets t LEFT JOIN (SELECT * FROM breakdown WHERE {_OCTOBER}) b ON b.owner_id = t.owner_id AND b.category = t.category_id GROUP BY 1""")
def budget_totals(x: Inputs) -> DataFrame:
    return pr.budget_totals(budget_status(x))


@query("owner_id category_id:text target_cents spent_cents remaining_cents percent_used:real row_count", f"""
    SELECT coalesce(t.owner_id, b.owner_id) AS owner_id, coalesce(t.category_id, b.category) AS category_id, coalesce(monthly_target_cents, 0) AS target_cents,
        coalesce(net_cents, 0) AS spent_cents, CASE WHEN monthly_target_cents > 0 THEN monthly_target_cents - coalesce(net_cents, 0) ELSE 0 END AS remaining_cents,
        CASE WHEN monthly_target_cents > 0 THEN round(coalesce(net_cents, 0) * 100.0 / monthly_target_cents, 1) ELSE 0 END AS percent_used, coalesce(row_count, 0) AS row_count
    FROM budget_targets t FULL JOIN (SELECT * FROM breakdown WHERE {_OCTOBER}) b ON b.owner_id = t.owner_id AND b.category = t.category_id
    WHERE coalesce(monthly_target_cents, 0) > 0 OR coalesce(net_cents, 0) > 0""")
def budget_page(x: Inputs) -> DataFrame:
    return pr.budget_page(pr.category_breakdown(x.classified_months(2)).filter(_OCTOBER), x.rules("budget_targets"))


# --- drill-down and review -------------------------------------------------------------------

def _scope_check(inside: str, value: str) -> str:
    return f"""SELECT owner_id, month AS period_start, count(CASE WHEN {inside} THEN 1 END) AS row_count,
        sum(CASE WHEN {inside} THEN {value} ELSE 0 END) AS scope_total_cents,
        count(CASE WHEN NOT ({inside}) AND txn_type = 'TRANSFER' THEN 1 END) AS excluded_transfer_count,
        sum(CASE WHEN NOT ({inside}) AND txn_type = 'CREDIT_OTHER' THEN amount_cents ELSE 0 END) AS excluded_credit_cents
        FROM classified GROUP BY owner_id, month"""


_DRILL = "owner_id period_start:text row_count scope_total_cents excluded_transfer_count excluded_credit_cents"


@query(_DRILL, _scope_check("txn_type IN ('EXPENSE', 'REFUND')", "-amount_cents"))
def drill_down_spend(x: Inputs) -> DataFrame:
    return pr.drill_down_totals(x.classified, "spend")


@query(_DRILL, _scope_check("coalesce(category_id = 'dining', FALSE)", "abs(amount_cents)"))
def drill_down_category(x: Inputs) -> DataFrame:
    return pr.drill_down_totals(x.classified, "category:dining")


@query(_DRILL, _scope_check("merchant_norm = 'netflix.com'", "abs(amount_cents)"))
def drill_down_merchant(x: Inputs) -> DataFrame:
    return pr.drill_down_totals(x.classified, "merchant:NETFLIX.COM")


@query(_DRILL, _scope_check("txn_type NOT IN ('TRANSFER', 'CREDIT_OTHER')", "amount_cents"))
def drill_down_net(x: Inputs) -> DataFrame:
    return pr.drill_down_totals(x.classified, "net")


@query("owner_id fingerprint:text amount_cents", "SELECT owner_id, fingerprint, amount_cents FROM typed WHERE txn_type = 'INCOME'")
def rows_by_type(x: Inputs) -> DataFrame:
    return pr.drill_down(x.typed, "income")


@query("owner_id merchant_norm:text total_cents row_count", f"""
    SELECT n.owner_id, n.merchant_norm, sum(-amount_cents) AS total_cents, count(*) AS row_count
    FROM norm n LEFT JOIN category_overrides o ON o.owner_id = n.owner_id AND o.merchant_norm = n.merchant_norm
    WHERE amount_cents < 0 AND posted_at >= DATE '2001-01-01' AND posted_at < DATE '2001-11-01'
        AND coalesce(o.category_id, {k.category("n.merchant_norm || ' '")}) = 'dining' GROUP BY 1, 2""")
def category_merchants(x: Inputs) -> DataFrame:
    return pr.category_merchants(x.ledger, "dining", "2001-01-01", "2001-11-01", x.rules("category_overrides"))


@query("owner_id total_count income_count expense_count categorized_count uncategorized_count categorized_percent high_confidence_count low_confidence_count", """
    SELECT owner_id, count(*) AS total_count, count(CASE WHEN txn_type = 'INCOME' THEN 1 END) AS income_count,
        count(CASE WHEN txn_type = 'EXPENSE' THEN 1 END) AS expense_count,
        count(CASE WHEN txn_type = 'EXPENSE' AND category_id <> 'other' THEN 1 END) AS categorized_count,
        count(CASE WHEN txn_type = 'EXPENSE' AND category_id = 'other' THEN 1 END) AS uncategorized_count,
        CASE WHEN expense_count > 0 THEN round_even(categorized_count * 100.0 / expense_count, 0) ELSE 100 END AS categorized_percent,
        count(CASE WHEN confidence >= 0.8 THEN 1 END) AS high_confidence_count, count(CASE WHEN confidence < 0.8 THEN 1 END) AS low_confidence_count
    FROM classified GROUP BY owner_id""")
def review_coverage(x: Inputs) -> DataFrame:
    return pr.review_coverage(x.classified)


@query("owner_id fingerprint:text confidence:real", "SELECT owner_id, fingerprint, confidence FROM typed WHERE confidence < 0.8")
def low_confidence_rows(x: Inputs) -> DataFrame:
    return pr.low_confidence_rows(x.typed)


@query("owner_id fingerprint:text merchant_norm:text",
       "SELECT owner_id, fingerprint, merchant_norm FROM classified WHERE txn_type = 'EXPENSE' AND category_id = 'other'")
def uncategorised_rows(x: Inputs) -> DataFrame:
    return pr.uncategorised_rows(x.classified)


@query("owner_id fingerprint:text note:text tags:text", """
    SELECT p.owner_id, p.fingerprint, note, to_json(tag_list) AS tags FROM posted p LEFT JOIN notes n USING (owner_id, fingerprint)
    LEFT JOIN (SELECT owner_id, fingerprint, list_sort(list(DISTINCT tag)) AS tag_list FROM tags GROUP BY 1, 2) t USING (owner_id, fingerprint)""")
def notes_and_tags(x: Inputs) -> DataFrame:
    rows = pr.with_notes_and_tags(x.posted, x.rules("notes"), x.rules("tags"))
    return rows.withColumn("tags", F.to_json("tags"))


_HASHES = """
    SELECT owner_id, period_start, left(sha256('{"classifier_version":"1.0.0","end_date":"' || CAST(CAST(period_start + INTERVAL 1 MONTH AS DATE) AS VARCHAR)
        || '","report_version":"1.0.0","start_date":"' || CAST(period_start AS VARCHAR) || '","totals":{"credits_other_cents":' || CAST(credits_other_cents AS BIGINT)
        || ',"discretionary_cents":' || CAST(discretionary_cents AS BIGINT) || ',"fixed_obligations_cents":0,"income_cents":' || CAST(income_cents AS BIGINT)
        || ',"one_offs_cents":0,"refunds_cents":' || CAST(refunds_cents AS BIGINT) || ',"transfers_in_cents":' || CAST(transfers_in_cents AS BIGINT)
        || ',"transfers_out_cents":' || CAST(transfers_out_cents AS BIGINT) || ',"variable_essentials_cents":0},"transaction_count":' || transaction_count || '}'), 16) AS report_hash
    FROM reports"""


@query("owner_id period_start:text report_hash:text", _HASHES)
def report_hashes(x: Inputs) -> DataFrame:
    return pr.report_hash(_reports(x))


_TOTALS_TEXT = " || ',' || ".join(
    f"""'"{n}":' || """ + ("'0'" if n in ("fixed_obligations_cents", "variable_essentials_cents", "one_offs_cents") else f"CAST({n} AS BIGINT)") for n in pr.TOTALS)


@query("owner_id period_start:text document:text", f"""
    WITH o AS (SELECT owner_id, count(*) AS n FROM type_overrides GROUP BY 1), h AS (SELECT h.owner_id, h.period_start, report_hash FROM ({{HASHES}}) AS h)
    SELECT r.owner_id, r.period_start, '{{{{"period_label":"' || strftime(r.period_start, '%b %Y') || '","start_date":"' || r.period_start || '","end_date":"' || CAST(r.period_start + INTERVAL 1 MONTH AS DATE)
        || '","totals":{{{{' || {_TOTALS_TEXT} || '}}}},"transaction_count":' || transaction_count || ',"report_hash":"' || report_hash || '","active_overrides":' || coalesce(n, 0) || '}}}}' AS document
    FROM reports r JOIN h ON h.owner_id = r.owner_id AND h.period_start = r.period_start LEFT JOIN o ON o.owner_id = r.owner_id""".replace("{HASHES}", _HASHES).replace("{{", "{").replace("}}", "}"))
def report_documents(x: Inputs) -> DataFrame:
    return pr.report_document(_reports(x), x.rules("type_overrides"))


# --- dashboard ---------------------------------------------------------------------------------

@query("owner_id months_with_data avg_savings_rate_pct:real income_cv:real savings_streak income_stability:text", """
    WITH h AS (SELECT owner_id, period_start, income_cents, net_cents, round_even(net_cents * 100.0 / CAST(income_cents AS DOUBLE), 1) AS rate,
        sum(CASE WHEN net_cents > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY owner_id ORDER BY period_start DESC) AS misses FROM reports WHERE income_cents > 0),
    a AS (SELECT owner_id, count(*) AS months_with_data, round_even(avg(rate), 1) AS avg_savings_rate_pct,
        round_even(stddev_pop(income_cents) / avg(income_cents) * 100, 1) AS income_cv, count(CASE WHEN misses = 0 THEN 1 END) AS savings_streak FROM h GROUP BY owner_id)
    SELECT *, CASE WHEN income_cv >= 25 THEN 'variable' WHEN income_cv >= 10 THEN 'moderate' ELSE 'stable' END AS income_stability FROM a""")
def savings_insights(x: Inputs) -> DataFrame:
    return dashboard.insights(_reports(x))


@query("owner_id period_start:text avg_income_cents avg_cash_flow_cents avg_savings_rate_pct:real", """
    SELECT owner_id, period_start, CASE WHEN count(*) OVER b = 3 THEN sum(income_cents) OVER b // 3 ELSE 0 END AS avg_income_cents,
        CASE WHEN count(*) OVER b = 3 THEN CAST(floor(sum(income_cents - discretionary_cents) OVER b / 3.0) AS BIGINT) ELSE 0 END AS avg_cash_flow_cents,
        CASE WHEN count(*) OVER b = 3 THEN coalesce(round_even(avg(CASE WHEN income_cents > 0 THEN net_cents / CAST(income_cents AS DOUBLE) * 100 END) OVER b, 1), 0) ELSE 0 END AS avg_savings_rate_pct
    FROM reports WINDOW b AS (PARTITION BY owner_id ORDER BY period_start ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def prior_averages(x: Inputs) -> DataFrame:
    return dashboard.prior_averages(pr.period_view(_reports(x)))


_AVERAGES = f"""WITH a AS (SELECT owner_id, category, sum(CASE WHEN period_start = DATE '2001-11-01' THEN net_cents END) AS current_cents,
        sum(CASE WHEN period_start = DATE '2001-10-01' THEN net_cents END) AS previous_cents,
        CAST(floor(sum(CASE WHEN period_start < DATE '2001-11-01' THEN net_cents END) / CAST(nullif(count(CASE WHEN period_start < DATE '2001-11-01' THEN 1 END), 0) AS DOUBLE)) AS BIGINT) AS avg_cents
        FROM breakdown WHERE period_start >= DATE '2001-08-01' AND period_start <= DATE '2001-11-01' GROUP BY owner_id, category)"""


@query("owner_id category:text current_cents previous_cents avg_cents outlier_percent", _AVERAGES + """
    SELECT *, CASE WHEN avg_cents > 0 AND current_cents > avg_cents THEN (current_cents - avg_cents) * 100 // avg_cents END AS outlier_percent FROM a""")
def category_averages(x: Inputs) -> DataFrame:
    return dashboard.category_averages(pr.category_breakdown(x.classified_months(4)), x.as_of)


@query("owner_id place category:text delta_cents", _AVERAGES + """
    SELECT owner_id, category, current_cents - avg_cents AS delta_cents,
        row_number() OVER (PARTITION BY owner_id ORDER BY current_cents - avg_cents DESC, category) AS place
    FROM a WHERE avg_cents > 0 AND current_cents - avg_cents > 3000 QUALIFY place <= 2""")
def top_movers(x: Inputs) -> DataFrame:
    return dashboard.top_movers(category_averages(x))


@query("owner_id place category:text projected_cents variance_cents", _AVERAGES + """
    SELECT owner_id, category, CAST(trunc(current_cents / (5 / 30.0)) AS BIGINT) AS projected_cents, projected_cents - avg_cents AS variance_cents,
        row_number() OVER (PARTITION BY owner_id ORDER BY projected_cents - avg_cents DESC, category) AS place
    FROM a WHERE avg_cents > 0 AND CAST(trunc(current_cents / (5 / 30.0)) AS BIGINT) - avg_cents > 2000 QUALIFY place <= 3""")
def pace_drivers(x: Inputs) -> DataFrame:
    return dashboard.pace_drivers(category_averages(x), x.as_of)


@query("owner_id spent_cents projected_cents avg_cents variance_cents variance_pct", """
    WITH v AS (SELECT owner_id, period_start, discretionary_cents AS spent_cents,
        sum(discretionary_cents) OVER r // count(*) OVER r AS avg_cents FROM reports WINDOW r AS (PARTITION BY owner_id ORDER BY period_start ROWS 2 PRECEDING))
    SELECT owner_id, spent_cents, CAST(trunc(spent_cents / CAST(5 / 30.0 AS DOUBLE)) AS BIGINT) AS projected_cents, avg_cents, projected_cents - avg_cents AS variance_cents,
        CASE WHEN avg_cents > 0 THEN round_even((projected_cents - avg_cents) * 100 / CAST(avg_cents AS DOUBLE), 0) ELSE 0 END AS variance_pct
    FROM v WHERE period_start = DATE '2001-11-01'""")
def month_pace(x: Inputs) -> DataFrame:
    return dashboard.pace(pr.period_view(_reports(x)), x.as_of)


@query("owner_id category:text months_increasing current_cents avg_cents", """
    WITH c AS (SELECT DISTINCT owner_id, category FROM breakdown WHERE period_start >= DATE '2001-08-01' AND period_start <= DATE '2001-11-01'),
    p AS (SELECT owner_id, category,
        max(CASE WHEN period_start = DATE '2001-11-01' THEN net_cents END) AS m0, max(CASE WHEN period_start = DATE '2001-10-01' THEN net_cents END) AS m1,
        max(CASE WHEN period_start = DATE '2001-09-01' THEN net_cents END) AS m2, max(CASE WHEN period_start = DATE '2001-08-01' THEN net_cents END) AS m3
        FROM breakdown GROUP BY 1, 2),
    z AS (SELECT owner_id, category, coalesce(m0, 0) AS m0, coalesce(m1, 0) AS m1, coalesce(m2, 0) AS m2, coalesce(m3, 0) AS m3 FROM c JOIN p USING (owner_id, category))
    SELECT owner_id, category, 3 AS months_increasing, m0 AS current_cents, CAST(floor((m1 + m2 + m3) / 3.0) AS BIGINT) AS avg_cents
    FROM z WHERE m0 > m1 AND m1 > m2 AND m2 > m3""")
def rising_categories(x: Inputs) -> DataFrame:
    return dashboard.rising_categories(dashboard.category_history(pr.category_breakdown(x.classified_months(4)), x.as_of))


@query("owner_id merchant_norm:text current_cents avg_cents deviation_pct", """
    WITH b AS (SELECT owner_id, merchant_norm FROM classes WHERE is_recurring AND NOT is_transfer AND pattern_class IN ('utility', 'insurance')),
    r AS (SELECT t.owner_id, t.merchant_norm, t.posted_at >= DATE '2001-11-01' AS now, -amount_cents AS cents, posted_at, fingerprint FROM typed t JOIN b USING (owner_id, merchant_norm)
        WHERE txn_type = 'EXPENSE' AND posted_at >= DATE '2001-08-01' AND posted_at < DATE '2001-12-01'),
    f AS (SELECT owner_id, merchant_norm, arg_max(cents, (posted_at, fingerprint)) FILTER (WHERE now) AS current_cents,
        count(*) FILTER (WHERE NOT now) AS past, sum(cents) FILTER (WHERE NOT now) // nullif(count(*) FILTER (WHERE NOT now), 0) AS avg_cents FROM r GROUP BY 1, 2)
    SELECT *, abs(current_cents - avg_cents) * 100 // avg_cents AS deviation_pct FROM f
    WHERE current_cents IS NOT NULL AND past >= 2 AND avg_cents > 0 AND abs(current_cents - avg_cents) * 100.0 / avg_cents > 15""")
def bill_deviations(x: Inputs) -> DataFrame:
    return dashboard.bill_deviations(x.typed_months(4), bills(x.patterns), x.as_of)


@query("owner_id row_count total_cents display_name:text updated_count", f"""
    SELECT owner_id, count(*) AS row_count, sum(CASE WHEN amount_cents < 0 THEN -amount_cents ELSE 0 END) AS total_cents, 'Netflix' AS display_name,
        count(CASE WHEN updated_at > created_at THEN 1 END) AS updated_count
    FROM norm WHERE merchant_norm = 'netflix.com' AND posted_at BETWEEN {k.AS_OF} - 400 AND {k.AS_OF} GROUP BY owner_id""")
def payee_history(x: Inputs) -> DataFrame:
    rows = dashboard.payee_history(x.ledger, x.accounts, "NETFLIX.COM", x.as_of)
    changed = rows.groupBy("owner_id").agg(F.count("last_updated").alias("updated_count"))
    return dashboard.payee_totals(rows).join(changed, "owner_id")


@query("owner_id place merchant_norm:text occurrences avg_cents", """
    SELECT owner_id, merchant_norm, count(*) AS occurrences, CAST(trunc(avg(-amount_cents)) AS BIGINT) AS avg_cents,
        row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, CAST(trunc(avg(-amount_cents)) AS BIGINT) DESC, merchant_norm) AS place
    FROM norm WHERE amount_cents < 0 AND contains(merchant_norm, 'disney') GROUP BY owner_id, merchant_norm""")
def payee_pick(x: Inputs) -> DataFrame:
    return dashboard.payee_pick(x.ledger, " Disney ")


# --- roll-ups and month tools --------------------------------------------------------------------

def _rollup_check(period: str) -> str:
    return f"""SELECT owner_id, {period} AS period, min(posted_at) AS first_date, sum(amount_cents) AS net_cents,
        sum(CASE WHEN amount_cents < 0 THEN -amount_cents ELSE 0 END) AS outflow_cents,
        sum(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END) AS inflow_cents, count(*) AS row_count FROM ledger GROUP BY 1, 2"""


_ROLLUP = "owner_id period:text first_date:text net_cents outflow_cents inflow_cents row_count"


@query(_ROLLUP, _rollup_check("CAST(posted_at AS VARCHAR)"))
def daily_rollup(x: Inputs) -> DataFrame:
    return month_tools.rollup(x.ledger, "day")


@query(_ROLLUP, _rollup_check("strftime(posted_at, '%Y-%W')"))
def weekly_rollup(x: Inputs) -> DataFrame:
    return month_tools.rollup(x.ledger, "week")


@query(_ROLLUP, _rollup_check("strftime(posted_at, '%Y-%m')"))
def monthly_rollup(x: Inputs) -> DataFrame:
    return month_tools.rollup(x.ledger, "month")


@query(_ROLLUP, _rollup_check("CAST(posted_at AS VARCHAR)").replace("FROM ledger", "FROM event_ledger"))
def event_daily_rollup(x: Inputs) -> DataFrame:
    return month_tools.rollup(x.event_ledger, "day")


@query("owner_id section:text rank label:text amount_usd:real", """
    WITH r AS (SELECT owner_id, amount_cents, coalesce(nullif(merchant, ''), nullif(description, '')) AS label, trim(lower(label)) AS m FROM ledger
        WHERE posted_at >= DATE '2001-09-01' AND posted_at < DATE '2001-10-01'),
    src AS (SELECT t.owner_id, t.m, arg_min(i.name, i.rule_order) AS source FROM (SELECT DISTINCT owner_id, m FROM r) t
        JOIN income_rules i ON i.owner_id = t.owner_id AND contains(t.m, lower(i.pattern)) GROUP BY 1, 2),
    inc AS (SELECT r.*, s.source FROM r LEFT JOIN src s USING (owner_id, m) WHERE amount_cents > 0),
    cut AS (SELECT p.owner_id, merchant_norm AS label, round(median_cents / 100.0, 2) AS usd,
        row_number() OVER (PARTITION BY p.owner_id ORDER BY round(median_cents / 100.0, 2) DESC, merchant_norm) - 1 AS rank
        FROM patterns p LEFT JOIN (SELECT owner_id, payee_norm FROM watchlist WHERE status = 'keep') w ON w.owner_id = p.owner_id AND w.payee_norm = p.merchant_norm
        WHERE is_recurring AND w.payee_norm IS NULL AND median_cents >= 500 QUALIFY rank < 15),
    s AS (SELECT o.owner_id, coalesce(income, 0) AS income, coalesce(matched, 0) AS matched, coalesce(spend, 0) AS spend, coalesce(saved, 0) AS saved
        FROM (SELECT owner_id, sum(CASE WHEN amount_cents < 0 THEN -amount_cents ELSE 0 END) AS spend FROM r GROUP BY 1) o
        LEFT JOIN (SELECT owner_id, sum(amount_cents) AS income, sum(CASE WHEN source IS NOT NULL THEN amount_cents END) AS matched FROM inc GROUP BY 1) i USING (owner_id)
        LEFT JOIN (SELECT owner_id, round(sum(usd), 2) AS saved FROM cut GROUP BY 1) c USING (owner_id)),
    v AS (SELECT owner_id, m, min(label) AS label, sum(-amount_cents) AS cents FROM r WHERE amount_cents < 0 GROUP BY 1, 2),
    q AS (SELECT owner_id, coalesce(source, m) AS g, min(coalesce(source, label)) AS label, sum(amount_cents) AS cents FROM inc GROUP BY 1, 2)
    SELECT owner_id, 'summary' AS section, 0 AS rank, 'income_total' AS label, income / 100.0 AS amount_usd FROM s
    UNION ALL SELECT owner_id, 'summary', 1, 'spend_total', spend / 100.0 FROM s
    UNION ALL SELECT owner_id, 'summary', 2, 'net', (income - spend) / 100.0 FROM s
    UNION ALL SELECT owner_id, 'survival', 0, 'required_cuts_to_break_even', greatest(0, (spend - income) / 100.0) FROM s
    UNION ALL SELECT owner_id, 'survival', 1, 'cut_plan_savings', saved FROM s
    UNION ALL SELECT owner_id, 'survival', 2, 'net_after_cut_plan', (income - spend) / 100.0 + saved FROM s
    UNION ALL SELECT owner_id, 'income_quality', 0, 'matched_income_total', matched / 100.0 FROM s WHERE income > 0
    UNION ALL SELECT owner_id, 'income_quality', 1, 'unknown_income_total', (income - matched) / 100.0 FROM s WHERE income > 0
    UNION ALL SELECT owner_id, 'cut_plan', rank, label, usd FROM cut WHERE owner_id IN (SELECT owner_id FROM cut)
    UNION ALL (SELECT owner_id, 'top_spend_vendors', row_number() OVER (PARTITION BY owner_id ORDER BY cents DESC, label) - 1 AS n, label, cents / 100.0 FROM v QUALIFY n < 15)
    UNION ALL (SELECT owner_id, 'income_sources', row_number() OVER (PARTITION BY owner_id ORDER BY cents DESC, label) - 1 AS n, label, cents / 100.0 FROM q QUALIFY n < 15)""")
def survival_report(x: Inputs) -> DataFrame:
    marks = x.rules("watchlist").select("owner_id", F.col("payee_norm").alias("merchant_norm"), F.col("status").alias("watch_status"))
    items = x.patterns.filter("is_recurring").join(marks, ["owner_id", "merchant_norm"], "left").select(
        "owner_id", F.col("merchant_norm").alias("label"), F.round(F.col("median_amount_cents") / 100, 2).alias("impact_usd"), "watch_status")
    return month_tools.survival_report(x.ledger, x.rules("income_rules"), items, "2001-09-01")
