"""Building blocks of the SQL that checks results: views as common table expressions.

Written apart from the operators, in plain SQL over the driver's tables. The
fixed word lists and rules are shared, the logic is not.
"""

from __future__ import annotations

import re

from ..lexicon import categories, keywords as kw
from ..lexicon.services import known_services
from ..sources import driver_ledger, driver_rules

AS_OF = f"DATE '{driver_ledger.AS_OF}'"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def has_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


def whole_word(column: str, words: list[str]) -> str:
    return f"regexp_matches({column}, {text(chr(92) + 'b(' + '|'.join(words) + ')' + chr(92) + 'b')})"


def _rule_test(column: str, pattern: str) -> str:
    """The SQL engine's expressions have no look-ahead, so those two rules are spelled out."""
    if pattern.startswith(r"(city of \w+)(?!"):
        return (f"(regexp_matches({column}, 'city of \\w+') AND NOT regexp_matches({column}, "
                f"'city of \\w.*\\b(hall|limit|cashless|parking|airport)\\b'))")
    if pattern.startswith("(amazon(?!"):
        rest = pattern[1:-1].split("|")[1:]
        return f"(regexp_matches(replace({column}, 'amazon prime video', ''), 'amazon') OR regexp_matches({column}, {text('|'.join(rest))}))"
    return f"regexp_matches({column}, {text(pattern)})"


def category(column: str, value: str = "category") -> str:
    ordered = sorted(categories.CATEGORY_RULES, key=lambda r: -r[2])
    pick = {"category": lambda r: text(r[1]), "confidence": lambda r: str(r[2])}[value]
    last = {"category": "'other'", "confidence": "0.0"}[value]
    return "CASE " + " ".join(f"WHEN {_rule_test(column, r[0])} THEN {pick(r)}" for r in ordered) + f" ELSE {last} END"


def service(column: str, value: str = "name") -> str:
    at = {"name": 1, "cadence": 2}[value]
    return "CASE " + " ".join(f"WHEN contains({column}, {text(r[0])}) THEN {text(r[at])}" for r in known_services()) + " END"


def names(values: list[str]) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def first_family(column: str, families: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {has_any(column, words)} THEN {text(name)}" for name, words in families.items()) + " END"


def monthly(cents: str, cadence: str) -> str:
    return (f"CASE {cadence} WHEN 'annual' THEN {cents} // 12 WHEN 'quarterly' THEN {cents} // 3 WHEN 'bimonthly' THEN {cents} // 2 "
            f"WHEN 'weekly' THEN round_even({cents} * 52 / 12.0, 0) WHEN 'biweekly' THEN round_even({cents} * 26 / 12.0, 0) ELSE {cents} END")


MERCHANT_NORM = "trim(lower(coalesce(nullif(merchant, ''), nullif(description, ''), '')))"
_PRESENT = "coalesce(merchant, '') <> ''"

_TYPE = f"""CASE
    WHEN amount_cents <= 0 AND NOT is_card AND {has_any('merchant_norm', kw.CARD_PAYMENT)} THEN 'TRANSFER|TRANSFER_CC_PAYMENT|0.95'
    WHEN {has_any('merchant_norm', kw.TRANSFER)} THEN 'TRANSFER|TRANSFER_BANK_PATTERN|0.8'
    WHEN amount_cents <= 0 THEN 'EXPENSE|EXPENSE_DEFAULT|0.8'
    WHEN {has_any('merchant_norm', kw.BANK)} AND {has_any('merchant_norm', kw.BANK_DIRECTION)} THEN 'TRANSFER|TRANSFER_BANK_PATTERN|0.85'
    WHEN is_card THEN 'TRANSFER|TRANSFER_CC_PAYMENT|0.95'
    WHEN {has_any('merchant_norm', kw.REFUND)} THEN 'REFUND|REFUND_KEYWORD|0.7'
    WHEN {has_any('merchant_norm', kw.PAYROLL)} THEN 'INCOME|INCOME_PAYROLL|0.9'
    ELSE 'CREDIT_OTHER|CREDIT_UNCLASSIFIED|0.5' END"""

_PATTERN_CLASS = f"""CASE
    WHEN occurrence_count < 2 THEN 'uncategorized' WHEN is_transfer THEN 'transfer'
    WHEN {has_any('merchant_norm', kw.UTILITY)} AND cadence IN ('monthly', 'bimonthly') AND occurrence_count >= 3 THEN 'utility'
    WHEN {has_any('merchant_norm', kw.DEBT)} AND cadence = 'monthly' AND median_cents >= 10000 THEN 'debt_payment'
    WHEN {has_any('merchant_norm', kw.INSURANCE)} AND is_recurring AND median_cents >= 5000 THEN 'insurance'
    WHEN {has_any('merchant_norm', kw.SUBSCRIPTION)} AND is_recurring AND median_cents < 50000 THEN 'subscription'
    WHEN cadence = 'monthly' AND median_cents >= 50000 AND amount_cv < 0.10 AND {has_any('merchant_norm', kw.FINANCE)} THEN 'debt_payment'
    WHEN cadence = 'monthly' AND median_cents >= 100000 AND amount_cv < 0.10 THEN 'debt_payment'
    WHEN is_recurring AND cadence IN ('weekly', 'monthly', 'quarterly', 'annual', 'bimonthly') AND amount_cv < 0.05 AND median_cents < 30000 THEN 'subscription'
    WHEN cadence = 'monthly' AND occurrence_count >= 3 AND amount_cv >= 0.05 AND median_cents BETWEEN 3000 AND 100000 THEN 'utility'
    WHEN is_recurring AND cadence IN ('monthly', 'quarterly', 'annual') AND median_cents >= 5000 AND {has_any('merchant_norm', kw.INSURANCE_OR_PREMIUM)} THEN 'insurance'
    WHEN is_recurring AND cadence IN ('monthly', 'quarterly', 'annual') AND median_cents >= 20000 AND amount_cv < 0.1 THEN 'insurance'
    WHEN is_habitual THEN 'habitual' ELSE 'uncategorized' END"""


def patterns_of(days: int) -> str:
    return f"""
        WITH charges AS (
            SELECT owner_id, merchant_norm, posted_at, -amount_cents AS cents,
                posted_at - lag(posted_at) OVER (PARTITION BY owner_id, merchant_norm ORDER BY posted_at) AS gap
            FROM posted WHERE amount_cents < 0 AND merchant_norm <> '' AND posted_at BETWEEN {AS_OF} - {days} AND {AS_OF}),
        middle AS (SELECT owner_id, merchant_norm, CAST(trunc(quantile_cont(gap, 0.5)) AS BIGINT) AS gap_median FROM charges GROUP BY ALL),
        spread AS (SELECT owner_id, merchant_norm, any_value(gap_median) AS gap_median, quantile_cont(abs(gap - gap_median), 0.5) AS gap_mad
            FROM charges JOIN middle USING (owner_id, merchant_norm) GROUP BY owner_id, merchant_norm),
        figures AS (SELECT owner_id, merchant_norm, count(*) AS occurrence_count, CAST(trunc(quantile_cont(cents, 0.5)) AS BIGINT) AS median_cents,
                min(cents) AS min_cents, max(cents) AS max_cents, min(posted_at) AS first_seen, max(posted_at) AS last_seen,
                coalesce(stddev_samp(cents) / avg(cents), 0) AS amount_cv
            FROM charges GROUP BY owner_id, merchant_norm),
        judged AS (SELECT *, CASE WHEN occurrence_count >= 3 THEN gap_median END AS interval_days,
                coalesce(gap_mad <= greatest(7, gap_median * 0.3) AND gap_median BETWEEN 5 AND 400 AND occurrence_count >= 3, FALSE) AS is_recurring
            FROM figures JOIN spread USING (owner_id, merchant_norm))
        SELECT owner_id, merchant_norm, occurrence_count, median_cents, interval_days, min_cents, max_cents, first_seen, last_seen, amount_cv,
            is_recurring, NOT is_recurring AND occurrence_count >= 6 AS is_habitual,
            {has_any('merchant_norm', kw.PATTERN_TRANSFER)} AS is_transfer,
            CASE WHEN NOT is_recurring THEN CASE WHEN occurrence_count >= 6 THEN 'habitual' ELSE '' END
                WHEN gap_median BETWEEN 5 AND 10 THEN 'weekly' WHEN gap_median BETWEEN 12 AND 18 THEN 'biweekly'
                WHEN gap_median BETWEEN 25 AND 35 THEN 'monthly' WHEN gap_median BETWEEN 55 AND 70 THEN 'bimonthly'
                WHEN gap_median BETWEEN 85 AND 100 THEN 'quarterly' WHEN gap_median BETWEEN 330 AND 400 THEN 'annual' ELSE 'regular' END AS cadence
        FROM judged"""


_FIVE = f"""CASE
    WHEN amount_cents > 0 AND {has_any('merchant_norm', kw.CREDIT_TRANSFER)} THEN 'transfer'
    WHEN amount_cents > 0 AND {has_any('merchant_norm', kw.STRONG_INCOME)} THEN 'income'
    WHEN amount_cents > 0 THEN 'credit'
    WHEN NOT is_card AND {has_any('merchant_norm', kw.CARD_PAYMENT_OUT)} THEN 'transfer'
    WHEN {has_any('merchant_norm', kw.PATTERN_TRANSFER)} THEN 'transfer' ELSE 'one-off' END"""

# In the order they build on each other.
PARTS = {
    "ledger": driver_ledger.check_sql("ledger"),
    "accounts": driver_ledger.check_sql("accounts"),
    "event_ledger": driver_ledger.check_sql("event_ledger"),
    "norm": f"SELECT *, {MERCHANT_NORM} AS merchant_norm FROM ledger",
    "posted": "SELECT * FROM norm WHERE NOT coalesce(pending, FALSE)",
    "carded": "SELECT p.*, coalesce(contains(lower(a.type), 'credit'), FALSE) AS is_card FROM posted p LEFT JOIN accounts a USING (account_id)",
    "typed": f"""SELECT * EXCLUDE (verdict), split_part(verdict, '|', 1) AS txn_type, split_part(verdict, '|', 2) AS reason_code,
        CAST(split_part(verdict, '|', 3) AS DOUBLE) AS confidence, CAST(date_trunc('month', posted_at) AS DATE) AS month
        FROM (SELECT *, {_TYPE} AS verdict FROM carded) AS t""",
    "classified": f"""SELECT *, CASE WHEN txn_type IN ('EXPENSE', 'REFUND') THEN
        {category("lower(merchant_norm || ' ' || coalesce(description, merchant, ''))")} END AS category_id FROM typed""",
    "totals": """SELECT owner_id, month AS period_start,
        sum(CASE WHEN txn_type = 'INCOME' THEN amount_cents ELSE 0 END) AS income_cents,
        sum(CASE WHEN txn_type = 'EXPENSE' THEN abs(amount_cents) ELSE 0 END) AS discretionary_cents,
        sum(CASE WHEN txn_type = 'REFUND' THEN amount_cents ELSE 0 END) AS refunds_cents,
        sum(CASE WHEN txn_type = 'CREDIT_OTHER' THEN amount_cents ELSE 0 END) AS credits_other_cents,
        sum(CASE WHEN txn_type = 'TRANSFER' AND amount_cents > 0 THEN amount_cents ELSE 0 END) AS transfers_in_cents,
        sum(CASE WHEN txn_type = 'TRANSFER' AND amount_cents <= 0 THEN -amount_cents ELSE 0 END) AS transfers_out_cents,
        count(*) AS transaction_count, sum(CASE WHEN txn_type = 'CREDIT_OTHER' THEN 1 ELSE 0 END) AS unclassified_credit_count
        FROM typed GROUP BY owner_id, month""",
    "months6": f"SELECT CAST(date_trunc('month', {AS_OF}) AS DATE) - to_months(CAST(i AS INT)) AS period_start, i FROM range(0, 6) AS r(i)",
    "reports": """SELECT o.owner_id, CAST(m.period_start AS DATE) AS period_start, coalesce(t.income_cents, 0) AS income_cents,
        coalesce(t.discretionary_cents, 0) AS discretionary_cents, coalesce(t.refunds_cents, 0) AS refunds_cents,
        coalesce(t.income_cents + t.refunds_cents - t.discretionary_cents, 0) AS net_cents,
        coalesce(t.credits_other_cents, 0) AS credits_other_cents, coalesce(t.transfers_in_cents, 0) AS transfers_in_cents,
        coalesce(t.transfers_out_cents, 0) AS transfers_out_cents, coalesce(t.transaction_count, 0) AS transaction_count,
        coalesce(t.unclassified_credit_count, 0) AS unclassified_credit_count
        FROM (SELECT DISTINCT owner_id FROM accounts) o CROSS JOIN months6 m
        LEFT JOIN totals t ON t.owner_id = o.owner_id AND CAST(t.period_start AS DATE) = CAST(m.period_start AS DATE)""",
    "breakdown": f"""SELECT owner_id, month AS period_start, coalesce(category_id, 'other') AS category,
        sum(CASE WHEN txn_type = 'EXPENSE' THEN abs(amount_cents) ELSE 0 END) AS gross_cents,
        sum(CASE WHEN txn_type = 'REFUND' THEN amount_cents ELSE 0 END) AS refund_cents, count(*) AS row_count,
        sum(CASE WHEN txn_type = 'EXPENSE' THEN abs(amount_cents) ELSE -amount_cents END) AS net_cents
        FROM classified WHERE txn_type IN ('EXPENSE', 'REFUND') AND coalesce(category_id, 'other') NOT IN {names(categories.NOT_SPENDING)}
        GROUP BY owner_id, month, coalesce(category_id, 'other') HAVING gross_cents > 0 OR refund_cents > 0""",
    "patterns": patterns_of(400),
    "classes": f"SELECT *, {_PATTERN_CLASS} AS pattern_class FROM patterns",
    "five": f"SELECT *, {_FIVE} AS label FROM carded",
    "recent60": f"""SELECT n.owner_id, n.posted_at, n.merchant_norm, n.amount_cents, n.fingerprint, a.name AS account_name,
        coalesce(n.description, n.merchant, '') AS raw_description
        FROM norm n LEFT JOIN accounts a USING (account_id) WHERE n.posted_at BETWEEN {AS_OF} - 60 AND {AS_OF}""",
    **{name: sql.replace("{customer}", "customer").replace("{ledger}", "ledger") for name, sql in driver_rules.VIEWS.items()},
}


def with_parts(sql: str) -> str:
    """The statement with every part it uses, directly or through another part, put in front."""
    def used(body: str) -> set[str]:
        return {n for n in PARTS if re.search(rf"\b{n}\b", body)}

    needed, queue = set(), used(sql)
    while queue:
        name = queue.pop()
        if name not in needed:
            needed.add(name)
            queue |= used(PARTS[name]) - needed - {name}
    chosen = [f"{n} AS MATERIALIZED ({PARTS[n]})" for n in PARTS if n in needed]
    return f"WITH {', '.join(chosen)} {sql}" if chosen else sql
