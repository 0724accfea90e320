"""Queries: charge alerts and anomaly reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import detectors as det
from ..operators.duplicates import duplicate_groups
from ..operators.recurring import bills
from ..plans import dashboard
from ..plans import period_report as pr
from ..session import cut_lineage
from . import check_sql as k
from . import reports  # noqa: F401  (its checks are parts of one here)
from .recurrence import ALL_GROUPS
from .registry import CATALOG, Inputs, query

ALERT = "owner_id posted_at:text merchant_norm:text amount_cents"


def _rows(x: Inputs) -> DataFrame:
    return x.charges


_DUPLICATE = """SELECT DISTINCT a.owner_id, b.posted_at, a.merchant_norm, -a.amount_cents AS amount_cents, a.posted_at AS related_date, 0 AS extra
    FROM recent60 a JOIN recent60 b ON a.owner_id = b.owner_id AND a.merchant_norm = b.merchant_norm AND a.amount_cents = b.amount_cents
    AND a.account_name IS NOT DISTINCT FROM b.account_name AND b.posted_at - a.posted_at BETWEEN 1 AND 3 WHERE a.amount_cents < 0"""
_UNUSUAL = """SELECT r.owner_id, r.posted_at, r.merchant_norm, -r.amount_cents AS amount_cents, CAST(NULL AS DATE) AS related_date, median_cents AS extra FROM recent60 r
    JOIN patterns p ON p.owner_id = r.owner_id AND p.merchant_norm = r.merchant_norm
    WHERE occurrence_count >= 4 AND median_cents > 0 AND -amount_cents > 2 * median_cents AND -amount_cents > 2000"""
_TEST = "SELECT owner_id, posted_at, merchant_norm, -amount_cents AS amount_cents, CAST(NULL AS DATE) AS related_date, 0 AS extra FROM recent60 WHERE amount_cents BETWEEN -100 AND -1"
_ROUND = """SELECT f.owner_id, f.posted_at, f.merchant_norm, -f.amount_cents AS amount_cents, CAST(NULL AS DATE) AS related_date, 0 AS extra
    FROM (SELECT * FROM recent60 QUALIFY row_number() OVER (PARTITION BY owner_id, merchant_norm ORDER BY posted_at, fingerprint) = 1) f
    LEFT JOIN patterns p ON p.owner_id = f.owner_id AND p.merchant_norm = f.merchant_norm
    WHERE coalesce(occurrence_count, 0) <= 1 AND amount_cents IN (-5000, -10000, -15000, -20000, -25000)"""
_RAPID = """SELECT owner_id, posted_at, merchant_norm, amount_cents, CAST(NULL AS DATE) AS related_date, n AS extra FROM (
    SELECT d.owner_id, d.posted_at, d.merchant_norm, sum(-r.amount_cents) AS amount_cents, count(*) AS n
    FROM (SELECT DISTINCT owner_id, merchant_norm, posted_at FROM recent60 WHERE amount_cents < 0) d
    JOIN recent60 r ON r.owner_id = d.owner_id AND r.merchant_norm = d.merchant_norm AND r.amount_cents < 0 AND r.posted_at - d.posted_at BETWEEN 0 AND 1 GROUP BY 1, 2, 3) AS b
    WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY owner_id, merchant_norm ORDER BY posted_at) = 1"""
_RECHARGE = """SELECT r.owner_id, c.posted_at, r.merchant_norm, -c.amount_cents AS amount_cents, r.posted_at AS related_date, r.amount_cents AS extra FROM recent60 r
    JOIN recent60 c ON c.owner_id = r.owner_id AND c.merchant_norm = r.merchant_norm AND c.amount_cents < 0 AND c.posted_at - r.posted_at BETWEEN 0 AND 7
    AND abs(-c.amount_cents - r.amount_cents) <= r.amount_cents * 0.2 WHERE r.amount_cents > 0
    QUALIFY row_number() OVER (PARTITION BY r.owner_id, r.fingerprint ORDER BY c.posted_at, -c.amount_cents) = 1"""


@query(f"{ALERT} related_date:text", _DUPLICATE)
def duplicate_charges(x: Inputs) -> DataFrame:
    return det.duplicate_charges(_rows(x))


@query(ALERT, _UNUSUAL)
def unusual_amounts(x: Inputs) -> DataFrame:
    return det.unusual_amounts(_rows(x), x.patterns)


@query(ALERT, _TEST)
def small_test_charges(x: Inputs) -> DataFrame:
    return det.test_charges(_rows(x))


@query(ALERT, _ROUND)
def round_first_charges(x: Inputs) -> DataFrame:
    return det.round_first_charges(_rows(x), x.patterns)


@query(ALERT, _RAPID)
def rapid_fire(x: Inputs) -> DataFrame:
    return det.rapid_fire(_rows(x))


@query("owner_id merchant_norm:text burst_at:text fingerprint:text", f"""
    SELECT b.owner_id, b.merchant_norm, b.posted_at AS burst_at, r.fingerprint FROM ({_RAPID}) b
    JOIN recent60 r ON r.owner_id = b.owner_id AND r.merchant_norm = b.merchant_norm AND r.amount_cents < 0 AND r.posted_at - b.posted_at BETWEEN 0 AND 1""")
def rapid_fire_rows(x: Inputs) -> DataFrame:
    rows = _rows(x)
    return det.rapid_fire_rows(rows, det.rapid_fire(rows))


@query(ALERT, _RAPID.replace("recent60", "ev").replace("SELECT owner_id, posted_at", """WITH ev AS (SELECT *, lower(merchant) AS merchant_norm FROM event_ledger
    WHERE posted_at BETWEEN DATE '2023-12-01' AND DATE '2024-01-30') SELECT owner_id, posted_at""", 1))
def event_rapid_fire(x: Inputs) -> DataFrame:
    return det.rapid_fire(det.detector_rows(x.event_ledger, x.accounts, "2024-01-30"))


@query(f"{ALERT} related_date:text", _RECHARGE)
def refund_recharges(x: Inputs) -> DataFrame:
    return det.refund_recharges(_rows(x))


_FEED = " UNION ALL ".join(f"SELECT *, '{kind}' AS pattern_type, '{level}' AS severity FROM ({sql}) AS {kind}" for kind, level, sql in (
    ("duplicate_charge", "high", _DUPLICATE), ("unusual_amount", "high", _UNUSUAL), ("test_charge", "medium", _TEST),
    ("round_amount_spike", "medium", _ROUND), ("rapid_fire", "medium", _RAPID), ("refund_recharge", "low", _RECHARGE)))
_DOLLARS = "'$' || format('{{:.2f}}', CAST({} AS DOUBLE) / 100)".format
FEED_TEXTS = f"""SELECT *, CASE pattern_type WHEN 'duplicate_charge' THEN 'charged twice: ' || {_DOLLARS('amount_cents')} || ' on ' || related_date || ' and ' || posted_at
    WHEN 'unusual_amount' THEN {_DOLLARS('amount_cents')} || ' is ' || format('{{:.1f}}', floor(amount_cents / CAST(nullif(extra, 0) AS DOUBLE) * 10 + 0.5) / 10) || 'x the usual ' || {_DOLLARS('extra')}
    WHEN 'test_charge' THEN 'tiny charge, perhaps a card check: ' || {_DOLLARS('amount_cents')} WHEN 'round_amount_spike' THEN 'new merchant starts with a round $' || amount_cents // 100
    WHEN 'rapid_fire' THEN extra || ' charges within a day, together ' || {_DOLLARS('amount_cents')}
    ELSE 'Refund ' || {_DOLLARS('extra')} || ' on ' || related_date || ', then charge ' || {_DOLLARS('amount_cents')} || ' on ' || posted_at END AS detail FROM ({_FEED}) AS every"""
_SUPPRESSED = f"""SELECT f.* FROM ({_FEED}) AS f WHERE NOT EXISTS (SELECT 1 FROM merchant_rules r WHERE r.owner_id = f.owner_id
    AND r.merchant_pattern = f.merchant_norm AND r.rule_type IN ('trust', 'trust_' || f.pattern_type))"""


@query(f"{ALERT} pattern_type:text severity:text", _SUPPRESSED)
def alert_feed(x: Inputs) -> DataFrame:
    return det.alert_feed(_rows(x), x.patterns, x.rules("merchant_rules"))


@query("owner_id alert_key:text pattern_type:text key_merchant:text key_date:text", f"""
    SELECT s.owner_id, pattern_type || '|' || merchant_norm || '|' || amount_cents || '|' || posted_at AS alert_key, pattern_type, merchant_norm AS key_merchant, posted_at AS key_date
    FROM ({_SUPPRESSED}) AS s WHERE NOT EXISTS (SELECT 1 FROM alert_actions a WHERE a.owner_id = s.owner_id
        AND a.alert_key = s.pattern_type || '|' || s.merchant_norm || '|' || s.amount_cents || '|' || s.posted_at)""")
def open_alerts(x: Inputs) -> DataFrame:
    rows = det.unhandled(alert_feed(x), x.rules("alert_actions"))
    parts = text.split_alert_key(F.col("alert_key"))
    return rows.withColumn("key_merchant", parts["merchant_norm"]).withColumn("key_date", parts["posted_at"])


@query("owner_id merchant_pattern:text rule_type:text dismissals", """
    SELECT owner_id, merchant_norm AS merchant_pattern, 'trust_' || pattern_type AS rule_type, count(*) AS dismissals FROM alert_actions
    WHERE action = 'not_suspicious' GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def learned_rules(x: Inputs) -> DataFrame:
    return det.learned_rules(x.rules("alert_actions"))


@query("owner_id severity:text category:text title:text amount_cents", f"""
    WITH m AS (SELECT owner_id, merchant_norm, arg_max(-amount_cents, (posted_at, fingerprint)) AS now_cents FROM norm WHERE amount_cents < 0
        AND posted_at >= DATE '2001-10-01' AND posted_at < DATE '2001-11-01' AND NOT {k.has_any('merchant_norm', k.kw.PATTERN_TRANSFER)} GROUP BY 1, 2),
    j AS (SELECT m.*, p.is_recurring, occurrence_count, median_cents, first_seen FROM m LEFT JOIN patterns p ON p.owner_id = m.owner_id AND p.merchant_norm = m.merchant_norm),
    fam AS (SELECT *, {k.first_family('merchant_norm', k.kw.ALERT_FAMILIES)} AS family FROM m)
    SELECT owner_id, 'medium' AS severity, 'price_increase' AS category, 'Price increase: ' || merchant_norm AS title, now_cents - median_cents AS amount_cents FROM j
        WHERE is_recurring AND occurrence_count >= 3 AND median_cents > 0 AND (now_cents - median_cents > 200 OR (now_cents - median_cents) * 100.0 / median_cents > 10)
    UNION ALL SELECT owner_id, 'medium', 'renewal', 'Annual renewal soon: ' || merchant_norm, median_cents FROM patterns
        WHERE is_recurring AND cadence = 'annual' AND last_seen + CAST(interval_days AS INT) - {k.AS_OF} BETWEEN 1 AND 30
    UNION ALL SELECT owner_id, 'low', 'new_merchant', 'New merchant: ' || merchant_norm, now_cents FROM j
        WHERE (occurrence_count IS NULL OR (occurrence_count = 1 AND first_seen >= DATE '2001-10-01')) AND now_cents >= 2000
    UNION ALL SELECT owner_id, 'medium', 'bundle', 'Possible duplicate: ' || CASE family WHEN 'disney_bundle' THEN 'Disney Bundle' ELSE upper(left(family, 1)) || substr(family, 2) END,
        sum(now_cents) FROM fam WHERE family IS NOT NULL GROUP BY owner_id, family HAVING count(*) >= 2""")
def monthly_alerts(x: Inputs) -> DataFrame:
    return det.monthly_alerts(x.ledger, x.patterns, "2001-10-01", x.as_of)


_LABEL = f"""WITH l AS (SELECT owner_id, posted_at, amount_cents, fingerprint, coalesce(nullif(merchant, ''), nullif(description, '')) AS label FROM ledger
    WHERE posted_at BETWEEN {k.AS_OF} - 400 AND {k.AS_OF}), v AS (SELECT * FROM l WHERE label IS NOT NULL)"""


@query("owner_id label:text posted_at:text amount_cents baseline_cents", _LABEL + """,
    a AS (SELECT *, row_number() OVER (PARTITION BY owner_id, label ORDER BY posted_at DESC, fingerprint DESC) AS age, count(*) OVER (PARTITION BY owner_id, label) AS n FROM v),
    m AS (SELECT owner_id, label, quantile_cont(abs(amount_cents), 0.5) AS med FROM a WHERE age > 1 AND n >= 6 GROUP BY 1, 2)
    SELECT a.owner_id, a.label, posted_at, amount_cents, CAST(trunc(med) AS BIGINT) AS baseline_cents FROM a JOIN m USING (owner_id, label)
    WHERE age = 1 AND med <> 0 AND abs(amount_cents) > greatest(floor(med * 2.5), 10000)""")
def amount_spikes(x: Inputs) -> DataFrame:
    return det.amount_spikes(x.ledger, x.as_of, 400)


@query("owner_id label:text posted_at:text amount_cents copies", _LABEL + """
    SELECT owner_id, label, posted_at, amount_cents, count(*) AS copies FROM v GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""")
def exact_repeats(x: Inputs) -> DataFrame:
    return det.exact_repeats(x.ledger, x.as_of, 400)


@query("owner_id label:text", _LABEL + f"""
    SELECT DISTINCT owner_id, label FROM v WHERE posted_at >= {k.AS_OF} - 14
    EXCEPT SELECT owner_id, label FROM v WHERE posted_at >= {k.AS_OF} - 104 AND posted_at < {k.AS_OF} - 14""")
def new_labels(x: Inputs) -> DataFrame:
    return det.new_labels(x.ledger, x.as_of)


@query("owner_id place fingerprint:text amount_cents", f"""
    SELECT owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY abs(amount_cents) DESC, posted_at, fingerprint) AS place, fingerprint, amount_cents
    FROM norm WHERE posted_at BETWEEN {k.AS_OF} - 60 AND {k.AS_OF} QUALIFY place <= 10""")
def largest_rows(x: Inputs) -> DataFrame:
    return det.largest_rows(x.ledger, x.as_of, 60, 10)


_FEED_ITEMS = f"""WITH alert AS (SELECT owner_id, pattern_type || '|' || merchant_norm || '|' || amount_cents || '|' || posted_at AS item_key, -amount_cents AS item_rank
        FROM ({_SUPPRESSED}) AS s WHERE pattern_type = 'unusual_amount'),
    item AS (SELECT owner_id, 1 AS section, 'alert' AS item_type, item_key, item_rank, 4 AS most FROM alert
        UNION ALL SELECT owner_id, 2, 'category_trend', 'trend_' || category, -current_cents, 2 FROM ({CATALOG['rising_categories'].check}) AS rising
        UNION ALL SELECT owner_id, 3, 'bill_deviation', 'bill_' || merchant_norm, -current_cents, 2 FROM ({CATALOG['bill_deviations'].check}) AS off
        UNION ALL SELECT owner_id, 4, 'duplicate_sub', 'dup_' || group_name, -total_monthly_cents, 4 FROM ({ALL_GROUPS}) AS twice WHERE severity = 'high'),
    few AS (SELECT * FROM item QUALIFY row_number() OVER (PARTITION BY owner_id, section ORDER BY item_rank, item_key) <= most)"""


@query("owner_id place section item_type:text item_key:text", _FEED_ITEMS + """
    SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY section, item_rank, item_key) AS place FROM few QUALIFY place <= 4""")
def attention_feed(x: Inputs) -> DataFrame:
    rows = x.charges
    alerts = cut_lineage(det.alert_feed(rows, x.patterns, x.rules("merchant_rules")))
    typed = cut_lineage(x.classified_months(4))
    rising = dashboard.rising_categories(dashboard.category_history(pr.category_breakdown(typed), x.as_of))
    off = dashboard.bill_deviations(typed, bills(x.patterns), x.as_of)
    return dashboard.attention_feed(alerts, rising, off, duplicate_groups(x.patterns))
