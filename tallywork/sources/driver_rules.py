"""User tables over the driver's data: rules, overrides, targets, commitments, statements, logs.

One SQL text per view, shared by Spark and by the SQL that checks results.
{customer} and {ledger} stand for the tables a view reads.
"""

from __future__ import annotations

VIEWS = {
    "merchant_rules": """
        SELECT c_custkey AS owner_id, s.pattern AS merchant_pattern, s.kind AS rule_type
        FROM {customer} JOIN (VALUES (2, 'savings deposit', 'not_income'), (3, 'acme', 'income'), (5, 'Globex', 'income'),
            (10, 'salary', 'not_income'), (27, 'cloud storage co', 'trust_duplicate_charge'), (22, 'verify svc', 'trust')
        ) AS s(step, pattern, kind) ON c_custkey % s.step = 0""",
    "type_overrides": """
        SELECT c_custkey AS owner_id, CAST(NULL AS STRING) AS fingerprint, s.pattern AS merchant_pattern,
            s.kind AS target_type, s.step AS rule_order
        FROM {customer} JOIN (VALUES (4, 'cabinet', 'TRANSFER'), (6, 'Online Transfer', 'EXPENSE'), (8, 'transfer', 'CREDIT_OTHER')
        ) AS s(step, pattern, kind) ON c_custkey % s.step = 0
        UNION ALL
        SELECT owner_id, fingerprint, CAST(NULL AS STRING), 'REFUND', 0 FROM {ledger} WHERE fingerprint LIKE 'a0%'""",
    "category_overrides": """
        SELECT c_custkey AS owner_id, s.merchant AS merchant_norm, s.category AS category_id
        FROM {customer} JOIN (VALUES (3, 'kroger', 'dining'), (4, 'home depot', 'housing'), (5, 'target', 'gifts')
        ) AS s(step, merchant, category) ON c_custkey % s.step = 0""",
    "recurring_overrides": """
        SELECT c_custkey AS owner_id, s.merchant AS merchant_norm, s.kind AS override_type
        FROM {customer} JOIN (VALUES (7, 'netflix.com', 'bill'), (11, 'water utility district', 'subscription'), (13, 'netflix.com', 'ignore')
        ) AS s(step, merchant, kind) ON c_custkey % s.step = 0 AND (s.step <> 13 OR c_custkey % 7 <> 0)""",
    "budget_targets": """
        SELECT c_custkey AS owner_id, s.category AS category_id, CAST(s.cents + c_custkey % 10 * 1000 AS BIGINT) AS monthly_target_cents
        FROM {customer} JOIN (VALUES (1, 'utilities', 6000), (2, 'entertainment', 2000), (3, 'travel', 20000)
        ) AS s(step, category, cents) ON c_custkey % s.step = 0""",
    "commitments": """
        SELECT c_custkey AS owner_id, s.id AS commitment_id, s.name AS name, s.merchant AS merchant_norm,
            CAST(s.cents AS BIGINT) AS expected_cents, s.cadence AS cadence, CAST(s.day AS INT) AS day_of_month,
            CAST(s.ref AS DATE) AS reference_date, s.sure AS confirmed, s.source AS source, s.direction AS direction
        FROM {customer} JOIN (VALUES
            (1, 'Netflix', 'netflix.com', NULL, 'monthly', NULL, NULL, TRUE, 'detected', 'expense'),
            (2, 'Water', 'Water Utility District', 6000, 'monthly', 12, NULL, TRUE, 'manual', 'expense'),
            (3, 'Salary', 'globex salary', 250000, 'biweekly', NULL, '2000-11-10', TRUE, 'manual', 'income'),
            (4, 'Hulu', 'hulu', 799, 'monthly', 21, '2001-10-21', FALSE, 'detected', 'expense'),
            (5, 'Insurance', 'geico insurance', 30000, 'annual', NULL, '2000-12-01', TRUE, 'manual', 'expense'),
            (6, 'Gym', 'planet fitness gym', 4000, 'weekly', NULL, '2001-01-03', TRUE, 'manual', 'expense'),
            (7, 'Trip', '', 90000, 'one_time', NULL, '2001-11-20', TRUE, 'manual', 'expense'),
            (8, 'Cleaning', 'cleaner', 15000, 'quarterly', NULL, '2001-01-15', FALSE, 'dismissed', 'expense')
        ) AS s(id, name, merchant, cents, cadence, day, ref, sure, source, direction) ON c_custkey % s.id = 0""",
    "statements": """
        SELECT l.owner_id, l.account_id, d.day AS statement_date,
            CAST(sum(CASE WHEN l.posted_at <= d.day AND NOT l.pending THEN l.amount_cents ELSE 0 END)
                + (l.owner_id % 5 - 2) * (CASE WHEN l.owner_id % 3 = 0 THEN d.step * d.step ELSE 4 END) * 300 AS BIGINT) AS statement_balance_cents
        FROM {ledger} l JOIN (VALUES (1, DATE '2000-12-31'), (2, DATE '2001-03-31'), (3, DATE '2001-06-30'), (4, DATE '2001-09-30'),
            (5, DATE '2001-10-31')) AS d(step, day) ON d.step > 0
        GROUP BY l.owner_id, l.account_id, d.day, d.step""",
    "alert_actions": """
        SELECT c_custkey AS owner_id, s.key AS alert_key, s.action AS action, s.merchant AS merchant_norm, s.pattern AS pattern_type
        FROM {customer} JOIN (VALUES
            (1, 'test_charge|verify svc|100|2001-10-24', 'not_suspicious', 'verify svc', 'test_charge'),
            (2, 'test_charge|verify svc|100|2001-09-24', 'not_suspicious', 'verify svc', 'test_charge'),
            (3, 'rapid_fire|coffee kiosk|1800|2001-10-29', 'ack', 'coffee kiosk', 'rapid_fire')
        ) AS s(step, key, action, merchant, pattern) ON c_custkey % s.step = 0""",
    "notes": "SELECT owner_id, fingerprint, concat('note ', fingerprint) AS note FROM {ledger} WHERE fingerprint LIKE 'b%'",
    "tags": """
        SELECT owner_id, fingerprint, t.tag AS tag FROM {ledger} JOIN (VALUES ('b', 'work'), ('bc', 'tax'), ('c', 'home')) AS t(start, tag)
            ON left(fingerprint, length(t.start)) = t.start""",
    "income_rules": """
        SELECT c_custkey AS owner_id, s.pattern AS pattern, s.name AS name, s.step AS rule_order
        FROM {customer} JOIN (VALUES (1, 'globex', 'Globex'), (2, 'acme', 'Acme Corp'), (4, 'corp', 'Any Corp')
        ) AS s(step, pattern, name) ON c_custkey % s.step = 0""",
    "watchlist": """
        SELECT c_custkey AS owner_id, s.payee AS payee_norm, s.status AS status, s.note AS note, s.handled AS handled_at
        FROM {customer} JOIN (VALUES (2, 'netflix.com', 'keep', '=cmd', '2001-10-01'), (3, 'hulu', 'cancel', NULL, NULL)
        ) AS s(step, payee, status, note, handled) ON c_custkey % s.step = 0""",
    "dismissed": "SELECT c_custkey AS owner_id, 'netflix inc' AS merchant_norm FROM {customer} WHERE c_custkey % 4 = 0",
    "runs": """
        SELECT owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY day) AS run_id, CAST(day AS TIMESTAMP) AS ran_at, fetched AS txns_fetched
        FROM (SELECT owner_id, CAST(created_at AS DATE) AS day, count(*) AS fetched FROM {ledger} GROUP BY owner_id, CAST(created_at AS DATE)) AS per_day""",
    "audit_log": """
        SELECT owner_id, CASE WHEN fingerprint LIKE '0%' THEN 'TXN_TYPE_OVERRIDE' ELSE 'CATEGORY_OVERRIDE' END AS event_type,
            updated_at AS timestamp, 'transaction' AS entity_type, fingerprint AS entity_id, CAST(amount_cents AS STRING) AS new_value
        FROM {ledger}""",
}
