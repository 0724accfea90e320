"""Queries: merchant patterns, subscriptions, bills, price changes, duplicates, commitments, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money
from ..operators import commitments as cm
from ..operators import duplicates as dup
from ..operators import recurring as rec
from ..plans import period_report as pr
from ..plans import planner
from ..session import cut_lineage
from . import check_sql as k
from .registry import Inputs, query

CLASS_COLUMNS = "owner_id merchant_norm:text"


def _patterns(x: Inputs) -> DataFrame:
    return rec.merchant_patterns(x.last_400_days, x.as_of)


@query(f"{CLASS_COLUMNS} occurrence_count median_amount_cents median_interval_days amount_min_cents amount_max_cents first_seen:text "
       "last_seen:text amount_cv:real is_recurring:flag is_habitual:flag is_transfer:flag cadence:text",
       "SELECT *, median_cents AS median_amount_cents, interval_days AS median_interval_days, min_cents AS amount_min_cents, max_cents AS amount_max_cents FROM patterns")
def merchant_patterns(x: Inputs) -> DataFrame:
    return _patterns(x)


@query(f"{CLASS_COLUMNS} pattern_class:text", "SELECT * FROM classes")
def pattern_classes(x: Inputs) -> DataFrame:
    return rec.with_pattern_class(_patterns(x))


_FIRST = f"""first AS (SELECT c.owner_id, c.merchant_norm, c.cadence, c.first_seen, c.last_seen, median_cents AS charge_cents,
        {k.monthly('median_cents', 'c.cadence')} AS monthly_cents, {k.service('c.merchant_norm')} AS display_name
        FROM classes c LEFT JOIN recurring_overrides o ON o.owner_id = c.owner_id AND o.merchant_norm = c.merchant_norm
        WHERE is_recurring AND NOT is_transfer AND coalesce(o.override_type, '') NOT IN ('bill', 'ignore')
        AND (o.override_type = 'subscription' OR {k.service('c.merchant_norm')} IS NOT NULL OR pattern_class = 'subscription'))"""
_SECOND = f"""hist AS (SELECT n.owner_id, n.merchant_norm, count(*) AS n, CAST(trunc(quantile_cont(-amount_cents, 0.5)) AS BIGINT) AS cents,
        min(posted_at) AS first_seen, max(posted_at) AS last_seen, any_value({k.service('n.merchant_norm')}) AS display_name,
        any_value({k.service('n.merchant_norm', 'cadence')}) AS usual
        FROM norm n WHERE amount_cents < 0 AND posted_at BETWEEN {k.AS_OF} - 400 AND {k.AS_OF}
        AND {k.service('n.merchant_norm')} IS NOT NULL AND NOT {k.has_any('n.merchant_norm', k.kw.PATTERN_TRANSFER)} GROUP BY 1, 2),
    open_hist AS (SELECT h.* FROM hist h LEFT JOIN recurring_overrides o ON o.owner_id = h.owner_id AND o.merchant_norm = h.merchant_norm
        WHERE coalesce(o.override_type, '') NOT IN ('bill', 'ignore')
        AND NOT EXISTS (SELECT 1 FROM first f WHERE f.owner_id = h.owner_id AND f.merchant_norm = h.merchant_norm)),
    second AS (SELECT *, CASE WHEN n <= 2 AND {k.AS_OF} - last_seen >= 45 AND cents >= 4000 THEN 'annual'
        WHEN n = 2 AND last_seen - first_seen >= 300 THEN 'annual' WHEN n = 2 AND last_seen - first_seen >= 80 THEN 'quarterly'
        WHEN usual = 'annual' THEN 'annual' ELSE 'monthly' END AS cadence FROM open_hist)"""


SUBSCRIBED = ", ".join(part.replace("recurring_overrides", "(SELECT * FROM recurring_overrides WHERE FALSE)") for part in (_FIRST, _SECOND))


@query(f"{CLASS_COLUMNS} monthly_cents cadence:text first_seen:text last_seen:text is_known_service:flag display_name:text charge_cents",
       f"""WITH {_FIRST}, {_SECOND}
    SELECT owner_id, merchant_norm, monthly_cents, cadence, first_seen, last_seen, display_name IS NOT NULL AS is_known_service, display_name, charge_cents FROM first
    UNION ALL SELECT owner_id, merchant_norm, CASE cadence WHEN 'annual' THEN cents // 12 WHEN 'quarterly' THEN cents // 3 ELSE cents END, cadence,
        first_seen, last_seen, TRUE, display_name, cents FROM second""")
def subscriptions(x: Inputs) -> DataFrame:
    return rec.subscriptions(x.last_400_days, x.as_of, patterns=x.patterns, type_overrides=x.rules("recurring_overrides"))


@query(f"{CLASS_COLUMNS} monthly_cents cadence:text bill_type:text last_seen:text", f"""
    SELECT c.owner_id, c.merchant_norm, {k.monthly('median_cents', 'c.cadence')} AS monthly_cents, c.cadence, last_seen,
        CASE WHEN o.override_type = 'bill' THEN 'utility' ELSE pattern_class END AS bill_type
    FROM classes c LEFT JOIN recurring_overrides o ON o.owner_id = c.owner_id AND o.merchant_norm = c.merchant_norm
    WHERE is_recurring AND NOT is_transfer AND coalesce(o.override_type, '') NOT IN ('subscription', 'ignore')
        AND (o.override_type = 'bill' OR pattern_class IN ('utility', 'insurance'))""")
def recurring_bills(x: Inputs) -> DataFrame:
    return rec.bills(_patterns(x), x.rules("recurring_overrides"))


@query(f"{CLASS_COLUMNS} old_cents new_cents change_pct:real change_date:text display_name:text", f"""
    WITH c AS (SELECT owner_id, merchant_norm, posted_at, -amount_cents AS cents, row_number() OVER w AS age, count(*) OVER (PARTITION BY owner_id, merchant_norm) AS n,
        lead(-amount_cents) OVER w AS before FROM norm WHERE amount_cents < 0 AND merchant_norm <> '' AND posted_at BETWEEN {k.AS_OF} - 180 AND {k.AS_OF}
        WINDOW w AS (PARTITION BY owner_id, merchant_norm ORDER BY posted_at DESC, amount_cents)),
    counts AS (SELECT owner_id, merchant_norm, cents, count(*) AS m FROM c WHERE age > 2 GROUP BY 1, 2, 3),
    usual AS (SELECT owner_id, merchant_norm, arg_max(cents, (m, cents)) AS old_cents, max(m) AS mode_n, sum(m) AS total FROM counts GROUP BY 1, 2),
    newest AS (SELECT owner_id, merchant_norm, cents AS new_cents FROM c WHERE age = 1 AND n >= 4),
    found AS (SELECT *, (new_cents - old_cents) / CAST(old_cents AS DOUBLE) * 100 AS change_pct FROM usual JOIN newest USING (owner_id, merchant_norm)
        WHERE mode_n / CAST(total AS DOUBLE) >= 0.6 AND abs((new_cents - old_cents) / CAST(old_cents AS DOUBLE) * 100) BETWEEN 10 AND 100)
    SELECT f.owner_id, f.merchant_norm, old_cents, new_cents, change_pct, {k.service('f.merchant_norm')} AS display_name,
        (SELECT min(posted_at) FROM c WHERE c.owner_id = f.owner_id AND c.merchant_norm = f.merchant_norm AND cents = new_cents AND (before IS NULL OR before = old_cents)) AS change_date
    FROM found f""")
def price_changes(x: Inputs) -> DataFrame:
    return rec.price_changes(x.ledger, x.as_of)


def _strict_check(raw: bool) -> str:
    rows = (f"SELECT owner_id, coalesce(nullif(merchant, ''), nullif(description, '')) AS label, posted_at, abs(amount_cents) AS cents FROM norm "
            f"WHERE posted_at BETWEEN {k.AS_OF} - 400 AND {k.AS_OF} AND coalesce(nullif(merchant, ''), nullif(description, '')) IS NOT NULL" if raw else
            f"SELECT owner_id, merchant_norm AS label, posted_at, -amount_cents AS cents FROM norm WHERE posted_at BETWEEN {k.AS_OF} - 400 AND {k.AS_OF} "
            f"AND amount_cents BETWEEN -30000 AND -1 AND merchant_norm <> '' AND NOT {k.has_any('merchant_norm', k.kw.NOISE)}")
    w = (0.5, 0.3, 0.2) if raw else (0.55, 0.35, 0.10)
    return f"""WITH r AS ({rows}),
    g AS (SELECT *, posted_at - lag(posted_at) OVER (PARTITION BY owner_id, label ORDER BY posted_at) AS gap FROM r),
    m AS (SELECT owner_id, label, quantile_cont(gap, 0.5) AS gm, CAST(trunc(quantile_cont(cents, 0.5)) AS BIGINT) AS med, quantile_cont(cents, 0.5) AS exact_med,
        count(*) AS n, count(gap) AS gaps, max(posted_at) AS last_seen, min(posted_at) AS first_seen, avg(gap) AS mean_gap FROM g GROUP BY 1, 2 HAVING count(*) >= 3),
    p AS (SELECT *, CASE WHEN gm BETWEEN 5 AND 9 THEN 'weekly' WHEN gm BETWEEN 25 AND 35 THEN 'monthly' WHEN gm BETWEEN 330 AND 400 THEN 'annual' END AS cadence,
        CASE WHEN gm <= 9 THEN 7 WHEN gm <= 35 THEN 30 ELSE 365 END AS step, CASE WHEN gm <= 9 THEN 2 WHEN gm <= 35 THEN 5 ELSE 20 END AS tol FROM m),
    f AS (SELECT g.owner_id, g.label, count(CASE WHEN abs(gap - step) <= tol THEN 1 END) / CAST(any_value(gaps) AS DOUBLE) AS fit,
        quantile_cont(abs(cents - exact_med), 0.5) AS mad FROM g JOIN p USING (owner_id, label) WHERE cadence IS NOT NULL GROUP BY 1, 2)
    SELECT owner_id, label, n AS occurrences, cadence || '{'' if raw else '-ish'}' AS cadence_guess, med AS amount_median_cents, CAST(trunc(mad) AS BIGINT) AS amount_mad_cents,
        CASE WHEN step = 365 THEN round_even(med / 12.0, 0) WHEN step = 30 THEN med ELSE round_even(med * 4.33, 0) END AS monthly_est_cents,
        round_even(mean_gap, 0) AS avg_delta_days, last_seen + step AS next_expected,
        round(fit * {w[0]} + {w[1]} + CASE WHEN {k.AS_OF} - last_seen <= step + tol THEN {w[2]} ELSE 0 END, 3) AS confidence
    FROM p JOIN f USING (owner_id, label) WHERE fit >= 0.66 AND mad <= greatest(200, floor(med * 0.05))"""


_STRICT = ("owner_id label:text occurrences cadence_guess:text amount_median_cents amount_mad_cents monthly_est_cents avg_delta_days "
           "next_expected:text confidence:real")


STRICT_CHECK = _strict_check(False)


@query(_STRICT, STRICT_CHECK)
def strict_candidates(x: Inputs) -> DataFrame:
    return rec.strict_candidates(x.ledger, x.as_of)


@query(_STRICT, _strict_check(True))
def report_candidates(x: Inputs) -> DataFrame:
    return rec.strict_candidates(x.ledger, x.as_of, raw_labels=True)


_MEMBERS = f"""WITH r AS (SELECT * FROM patterns WHERE is_recurring AND NOT is_transfer),
    m AS (SELECT owner_id, 'fuzzy_match' AS group_type, trim(regexp_replace(regexp_replace(regexp_replace(split_part(merchant_norm, '*', 1),
            '\\s*(\\.com|\\.net|\\.org|inc\\.?|llc\\.?|ltd\\.?|corp\\.?|\\*+)$', ''), '\\s+\\d{{4,}}$', ''), '\\s+', ' ', 'g')) AS group_name,
            merchant_norm, {k.monthly('median_cents', 'cadence')} AS monthly_cents FROM r
        {' '.join(f"UNION ALL SELECT owner_id, 'bundle_family', {k.text(n)}, merchant_norm, CASE cadence WHEN 'annual' THEN median_cents // 12 WHEN 'quarterly' THEN median_cents // 3 ELSE median_cents END FROM r WHERE {k.has_any('merchant_norm', w)}" for n, w in k.kw.DUPLICATE_FAMILIES.items())})"""


@query("owner_id group_type:text group_name:text member_count total_monthly_cents", _MEMBERS + """
    SELECT owner_id, group_type, group_name, count(*) AS member_count, sum(monthly_cents) AS total_monthly_cents
    FROM m WHERE group_name <> '' GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def duplicate_group_candidates(x: Inputs) -> DataFrame:
    rows = dup.sized_members(dup.group_members(x.patterns))
    return rows.select("owner_id", "group_type", "group_name", "member_count", "total_monthly_cents").distinct()


def _kept_groups(dismissed: str) -> str:
    """CTEs up to kept(owner_id, group_type, group_name, member_count, total, names): by falling cost, a group goes if it shares a merchant with one kept before."""
    return _MEMBERS + f""",
    sized AS (SELECT owner_id, group_type, group_name, count(*) AS member_count, sum(monthly_cents) AS total, list_sort(list(merchant_norm)) AS names,
            '#' || group_type || '|' || group_name AS mark FROM m WHERE group_name <> '' GROUP BY owner_id, group_type, group_name HAVING count(*) >= 2),
    free AS (SELECT * FROM sized g WHERE NOT EXISTS (SELECT 1 FROM ({dismissed}) d WHERE d.owner_id = g.owner_id AND list_contains(g.names, d.merchant_norm))),
    chosen AS (SELECT owner_id, list_reduce(list(list_prepend(mark, names) ORDER BY total DESC, group_type = 'bundle_family', group_name),
        lambda taken, one: CASE WHEN list_has_any(taken, one) THEN taken ELSE list_concat(taken, one) END) AS taken FROM free GROUP BY owner_id),
    kept AS (SELECT free.* FROM free JOIN chosen USING (owner_id) WHERE list_contains(taken, mark))"""


GROUP_ROWS = """SELECT owner_id, group_type, group_name, member_count, total AS total_monthly_cents, names, CASE WHEN group_type = 'bundle_family' THEN 'medium' ELSE 'high' END AS severity,
    CASE WHEN group_type = 'bundle_family' THEN group_name || ': ' || member_count || ' overlapping services'
        ELSE 'Similar merchant names: ' || array_to_string(names[1:3], ', ') END AS detail FROM kept"""
ALL_GROUPS = f"{_kept_groups('SELECT 0 AS owner_id, NULL AS merchant_norm WHERE FALSE')} {GROUP_ROWS}"


@query("owner_id group_type:text group_name:text member_count total_monthly_cents severity:text detail:text", f"{_kept_groups('SELECT * FROM dismissed')} {GROUP_ROWS}")
def duplicate_groups(x: Inputs) -> DataFrame:
    return dup.duplicate_groups(x.patterns, x.rules("dismissed"))


_FAMILY_ROWS = f"""WITH r AS (SELECT owner_id, posted_at, merchant_norm AS label, -amount_cents AS cents, {k.first_family('merchant_norm', k.kw.BUNDLE_FAMILIES)} AS family
        FROM norm WHERE amount_cents < 0 AND merchant_norm <> '' AND posted_at BETWEEN {k.AS_OF} - 400 AND {k.AS_OF}), f AS (SELECT * FROM r WHERE family IS NOT NULL)"""


@query("owner_id family:text labels charges nearby_pairs", _FAMILY_ROWS + """,
    s AS (SELECT owner_id, family, count(DISTINCT label) AS labels, count(*) AS charges FROM f GROUP BY 1, 2 HAVING count(DISTINCT label) >= 2),
    p AS (SELECT a.owner_id, a.family, count(*) AS n FROM f a JOIN f b ON a.owner_id = b.owner_id AND a.family = b.family AND a.label < b.label
        AND abs(a.posted_at - b.posted_at) <= 3 GROUP BY 1, 2)
    SELECT s.*, coalesce(n, 0) AS nearby_pairs FROM s LEFT JOIN p USING (owner_id, family)""")
def bundle_signals(x: Inputs) -> DataFrame:
    return dup.bundle_signals(x.ledger, x.as_of)


@query("owner_id family:text label:text charge_count first_date:text last_date:text median_cents min_cents max_cents median_interval_days typical_bill_day suggested_role:text",
       _FAMILY_ROWS + """,
    g AS (SELECT *, posted_at - lag(posted_at) OVER (PARTITION BY owner_id, family, label ORDER BY posted_at) AS gap FROM f),
    i AS (SELECT owner_id, family, label, count(*) AS charge_count, min(posted_at) AS first_date, max(posted_at) AS last_date,
        CAST(trunc(quantile_cont(cents, 0.5)) AS BIGINT) AS median_cents, min(cents) AS min_cents, max(cents) AS max_cents,
        CAST(trunc(quantile_cont(gap, 0.5) FILTER (WHERE gap > 0)) AS BIGINT) AS median_interval_days,
        CAST(trunc(quantile_cont(day(posted_at), 0.5)) AS BIGINT) AS typical_bill_day FROM g GROUP BY 1, 2, 3)
    SELECT *, CASE WHEN row_number() OVER (PARTITION BY owner_id, family ORDER BY charge_count DESC, last_date DESC, label) = 1 THEN 'primary_candidate' ELSE 'component_candidate' END AS suggested_role
    FROM i QUALIFY count(*) OVER (PARTITION BY owner_id, family) >= 2""")
def bundle_items(x: Inputs) -> DataFrame:
    return dup.bundle_items(x.ledger, x.as_of)


# --- commitments ---------------------------------------------------------------------

_FITS = f"""WITH j AS (SELECT c.*, l.posted_at, l.amount_cents, l.fingerprint, row_number() OVER (PARTITION BY c.owner_id, commitment_id ORDER BY l.posted_at DESC, l.fingerprint) AS age
        FROM commitments c JOIN ledger l ON l.owner_id = c.owner_id AND lower(l.merchant) = lower(c.merchant_norm)
        AND ((c.direction = 'expense' AND l.amount_cents < 0) OR (c.direction = 'income' AND l.amount_cents > 0))),
    mid AS (SELECT owner_id, commitment_id, list_sort(list(abs(amount_cents)))[len(list(abs(amount_cents))) // 2 + 1] AS recent FROM j WHERE age <= 3 GROUP BY 1, 2),
    a AS (SELECT j.*, abs(coalesce(expected_cents, recent)) AS anchor FROM j JOIN mid USING (owner_id, commitment_id)),
    b AS (SELECT * FROM a WHERE abs(amount_cents) >= floor(anchor * 0.5) AND abs(amount_cents) <= floor(anchor * 1.5)
        AND (day_of_month IS NULL OR abs(day(posted_at) - least(day_of_month, day(last_day(posted_at)))) <= 3)),
    fit AS (SELECT * FROM b QUALIFY source = 'manual' OR len(list(DISTINCT date_trunc('month', posted_at)) OVER (PARTITION BY owner_id, commitment_id)) >= 4)"""


@query("owner_id commitment_id fingerprint:text posted_at:text amount_cents anchor", _FITS + " SELECT * FROM fit")
def commitment_matches(x: Inputs) -> DataFrame:
    return cm.matching_rows(x.rules("commitments"), x.ledger)


_MONTHLY = """CAST(trunc(CASE WHEN cadence = 'one_time' OR resolved_cents IS NULL THEN 0 ELSE resolved_cents * CAST(CASE cadence WHEN 'weekly' THEN 4.33
    WHEN 'biweekly' THEN 2.17 WHEN 'quarterly' THEN 1.0 / 3 WHEN 'annual' THEN 1.0 / 12 ELSE 1 END AS DOUBLE) END) AS BIGINT)"""
_BOARD = _FITS + f""",
    mid2 AS (SELECT owner_id, commitment_id, list_sort(list(abs(amount_cents)))[len(list(abs(amount_cents))) // 2 + 1] AS recent
        FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, commitment_id ORDER BY posted_at DESC, fingerprint) AS n FROM fit WHERE expected_cents IS NULL) WHERE n <= 3 GROUP BY 1, 2),
    r AS (SELECT c.*, coalesce(expected_cents, recent) AS resolved_cents FROM commitments c LEFT JOIN mid2 USING (owner_id, commitment_id)),
    board AS (SELECT *, CASE WHEN source = 'dismissed' THEN 'dismissed' WHEN confirmed THEN 'confirmed' ELSE 'suggested' END AS status, {_MONTHLY} AS monthly_cents,
        CASE cadence WHEN 'monthly' THEN DATE '2001-12-01' + CAST(coalesce(day_of_month, day(reference_date), 1) - 1 AS INT)
            WHEN 'one_time' THEN CASE WHEN reference_date >= {k.AS_OF} THEN reference_date END
            WHEN 'weekly' THEN {k.AS_OF} + CAST((isodow(reference_date) - isodow({k.AS_OF}) + 7) % 7 AS INT)
            WHEN 'biweekly' THEN reference_date + CAST(14 * (({k.AS_OF} - reference_date) // 14 + 1) AS INT)
            WHEN 'quarterly' THEN reference_date + CAST(91 * (({k.AS_OF} - reference_date) // 91 + 1) AS INT)
            ELSE reference_date + CAST(365 * (({k.AS_OF} - reference_date) // 365 + 1) AS INT) END AS next_due FROM r)"""


@query("owner_id commitment_id status:text resolved_cents monthly_cents next_due:text", _BOARD + " SELECT * FROM board")
def commitment_board(x: Inputs) -> DataFrame:
    return x.board


_CONFIRMED = """sure AS (SELECT owner_id, sum(CASE WHEN status = 'confirmed' AND direction = 'income' THEN monthly_cents ELSE 0 END) AS income_cents,
        sum(CASE WHEN status = 'confirmed' AND direction = 'expense' THEN monthly_cents ELSE 0 END) AS expense_cents FROM board GROUP BY owner_id)"""


@query("owner_id income_cents expense_cents net_cents", _BOARD + f", {_CONFIRMED} SELECT *, income_cents - expense_cents AS net_cents FROM sure")
def commitment_totals(x: Inputs) -> DataFrame:
    return cm.board_totals(x.board)


@query("owner_id period_start:text avg_income_cents avg_recurring_cents", _BOARD + f""", {_CONFIRMED}
    SELECT v.owner_id, period_start, CASE WHEN s.income_cents > 0 THEN s.income_cents ELSE sum(v.income_cents) OVER w // count(*) OVER w END AS avg_income_cents,
        CASE WHEN s.expense_cents > 0 THEN s.expense_cents ELSE 0 END AS avg_recurring_cents
    FROM reports v LEFT JOIN sure s USING (owner_id) WINDOW w AS (PARTITION BY v.owner_id ORDER BY period_start ROWS 2 PRECEDING)""")
def trends_with_commitments(x: Inputs) -> DataFrame:
    view = pr.period_view(pr.period_reports(x.month_totals, x.accounts, x.as_of, 6))
    return pr.period_trends(view, confirmed=commitment_totals(x))


_BILLS = f"""bills AS (SELECT owner_id, merchant_norm, cadence, last_seen, {k.monthly('median_cents', 'cadence')} AS monthly_cents
    FROM classes WHERE is_recurring AND NOT is_transfer AND pattern_class IN ('utility', 'insurance'))"""


@query("owner_id merchant_norm:text cadence:text last_seen:text expected_date:text", f"""
    WITH {_BILLS.replace("pattern_class IN ('utility', 'insurance')", "TRUE")},
    e AS (SELECT *, last_seen + CASE cadence WHEN 'weekly' THEN 7 WHEN 'biweekly' THEN 14 WHEN 'monthly' THEN 30 WHEN 'bimonthly' THEN 60
        WHEN 'quarterly' THEN 91 WHEN 'annual' THEN 365 ELSE 30 END AS expected_date FROM bills)
    SELECT * FROM e WHERE DATE '2001-11-30' - expected_date BETWEEN 8 AND 90 AND NOT EXISTS (SELECT 1 FROM posted p WHERE p.owner_id = e.owner_id
        AND p.merchant_norm = e.merchant_norm AND p.posted_at >= DATE '2001-11-01' AND p.posted_at <= DATE '2001-11-30')""")
def not_yet_posted(x: Inputs) -> DataFrame:
    rows = _patterns(x).filter("is_recurring and not is_transfer").withColumn(
        "monthly_cents", money.monthly_equivalent(F.col("median_amount_cents"), F.col("cadence")))
    return cm.not_yet_posted(rows, x.ledger, "2001-11-30")


_INCOME = f"""rules AS (SELECT owner_id, merchant_pattern FROM merchant_rules WHERE rule_type = 'income'),
    dep AS (SELECT owner_id, trim(lower(merchant)) AS merchant_norm, posted_at, amount_cents FROM ledger WHERE amount_cents > 0 AND merchant <> ''),
    picked AS (SELECT * FROM dep d WHERE CASE WHEN EXISTS (SELECT 1 FROM rules r WHERE r.owner_id = d.owner_id)
        THEN EXISTS (SELECT 1 FROM rules r WHERE r.owner_id = d.owner_id AND contains(d.merchant_norm, lower(r.merchant_pattern)))
        ELSE {k.has_any('merchant_norm', k.kw.SUGGEST_INCOME)} END),
    gaps AS (SELECT *, posted_at - lag(posted_at) OVER (PARTITION BY owner_id, merchant_norm ORDER BY posted_at) AS gap FROM picked),
    paid AS (SELECT owner_id, merchant_norm, CAST(trunc(quantile_cont(amount_cents, 0.5)) AS BIGINT) AS expected_cents,
        CASE WHEN quantile_cont(gap, 0.5) BETWEEN 5 AND 10 THEN 'weekly' WHEN quantile_cont(gap, 0.5) BETWEEN 11 AND 18 THEN 'biweekly'
        WHEN quantile_cont(gap, 0.5) BETWEEN 19 AND 35 THEN 'monthly' WHEN quantile_cont(gap, 0.5) BETWEEN 80 AND 100 THEN 'quarterly' ELSE 'monthly' END AS cadence
        FROM gaps GROUP BY 1, 2 HAVING count(DISTINCT date_trunc('month', posted_at)) >= 2)"""


@query("owner_id merchant_norm:text cadence:text expected_cents", f"WITH {_INCOME} SELECT * FROM paid")
def income_merchants(x: Inputs) -> DataFrame:
    return cm.income_merchants(x.ledger, x.rules("merchant_rules").filter("rule_type = 'income'"))


@query("owner_id merchant_norm:text direction:text name:text expected_cents cadence:text reference_date:text", f"""
    WITH {_FIRST.replace("recurring_overrides", "(SELECT * FROM recurring_overrides WHERE FALSE)")},
        {_SECOND.replace("recurring_overrides", "(SELECT * FROM recurring_overrides WHERE FALSE)")}, {_BILLS}, {_INCOME},
    every AS (SELECT owner_id, merchant_norm, 'expense' AS direction, coalesce(display_name, merchant_norm) AS name, charge_cents AS expected_cents, cadence, 0 AS rank FROM first
        UNION ALL SELECT owner_id, merchant_norm, 'expense', coalesce(display_name, merchant_norm), cents, cadence, 0 FROM second
        UNION ALL SELECT owner_id, merchant_norm, 'expense', merchant_norm, monthly_cents, cadence, 1 FROM bills
        UNION ALL SELECT owner_id, merchant_norm, 'income', merchant_norm, expected_cents, cadence, 2 FROM paid),
    best AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY owner_id, merchant_norm, direction ORDER BY rank) = 1)
    SELECT b.*, (SELECT max(posted_at) FROM ledger l WHERE l.owner_id = b.owner_id AND lower(l.merchant) = b.merchant_norm) AS reference_date FROM best b
    WHERE NOT EXISTS (SELECT 1 FROM commitments c WHERE c.owner_id = b.owner_id AND lower(c.merchant_norm) = b.merchant_norm AND c.direction = b.direction)""")
def commitment_suggestions(x: Inputs) -> DataFrame:
    subs = rec.subscriptions(x.last_400_days, x.as_of, patterns=x.patterns)
    return cm.suggestions(subs, rec.bills(x.patterns), income_merchants(x), x.ledger, x.rules("commitments"))


# --- plans and projections ---------------------------------------------------------------

def _bucketed_check(months: int) -> str:
    return f"""WITH p6 AS ({k.patterns_of(35 * months)}),
    r AS (SELECT p.*, date_trunc('month', posted_at) AS month, q.is_transfer AS pt, q.is_recurring AS pr, q.is_habitual AS ph, q.cadence AS pc,
        CASE WHEN amount_cents <= 0 AND {k.has_any('p.merchant_norm', k.kw.CARD_PAYMENT)} THEN 'TRANSFER' WHEN q.is_transfer THEN 'TRANSFER'
            WHEN {k.has_any('p.merchant_norm', k.kw.TRANSFER)} THEN 'TRANSFER' WHEN amount_cents <= 0 THEN 'EXPENSE'
            WHEN {k.has_any('p.merchant_norm', k.kw.BANK)} AND {k.has_any('p.merchant_norm', k.kw.BANK_DIRECTION)} THEN 'TRANSFER'
            WHEN {k.has_any('p.merchant_norm', k.kw.REFUND)} THEN 'REFUND' WHEN {k.has_any('p.merchant_norm', k.kw.PAYROLL)} THEN 'INCOME' ELSE 'CREDIT_OTHER' END AS kind
        FROM posted p LEFT JOIN p6 q ON q.owner_id = p.owner_id AND q.merchant_norm = p.merchant_norm
        WHERE posted_at >= DATE '2001-11-01' - {30 * months} AND posted_at < DATE '2001-11-01'),
    b AS (SELECT *, CASE WHEN pr AND pc IN ('weekly', 'monthly', 'annual', 'biweekly', 'quarterly') THEN 'FIXED_OBLIGATIONS' WHEN ph THEN 'VARIABLE_ESSENTIALS'
        ELSE 'DISCRETIONARY' END AS bucket FROM r WHERE kind = 'EXPENSE'),
    mon AS (SELECT owner_id, bucket, month, sum(-amount_cents) AS cents, count(*) AS n, row_number() OVER (PARTITION BY owner_id, bucket ORDER BY month DESC) AS age
        FROM b GROUP BY 1, 2, 3),
    s AS (SELECT owner_id, bucket, count(*) AS months, round_even(avg(cents), 0) AS monthly_avg_cents, min(cents) AS monthly_min_cents, max(cents) AS monthly_max_cents,
        sum(n) AS transaction_count, CASE WHEN count(*) >= 3 AND avg(cents) FILTER (WHERE age > 2) > 0
            THEN (avg(cents) FILTER (WHERE age <= 2) - avg(cents) FILTER (WHERE age > 2)) / avg(cents) FILTER (WHERE age > 2) * 100 ELSE 0 END AS trend_percent,
        CASE WHEN count(*) > 1 THEN greatest(0, 1 - stddev_pop(cents) / avg(cents)) ELSE 0.5 END AS predictability FROM mon GROUP BY 1, 2)"""


_BUCKETED = _bucketed_check(6)


def _bucketed(x: Inputs) -> DataFrame:
    return planner.bucketed_rows(x.last_400_days, x.as_of)


@query("owner_id spending_bucket:text months monthly_avg_cents monthly_min_cents monthly_max_cents trend_percent:real predictability:real merchant_count transaction_count",
       _BUCKETED + """ SELECT s.*, bucket AS spending_bucket, merchant_count FROM s
    JOIN (SELECT owner_id, bucket, count(DISTINCT merchant_norm) AS merchant_count FROM b GROUP BY 1, 2) m USING (owner_id, bucket)""")
def spending_plan_buckets(x: Inputs) -> DataFrame:
    return planner.bucket_summary(_bucketed(x))


_PLAN = _BUCKETED + """,
    inc AS (SELECT owner_id, sum(c) // count(*) AS income_cents FROM (SELECT owner_id, month, sum(amount_cents) AS c FROM r WHERE kind = 'INCOME' GROUP BY 1, 2) GROUP BY 1),
    w AS (SELECT owner_id, sum(monthly_avg_cents) AS spend_cents, coalesce(max(predictability) FILTER (WHERE bucket = 'FIXED_OBLIGATIONS'), 0) AS fp,
        coalesce(max(monthly_avg_cents) FILTER (WHERE bucket = 'FIXED_OBLIGATIONS'), 0) AS fixed_obligations_cents,
        coalesce(max(monthly_avg_cents) FILTER (WHERE bucket = 'DISCRETIONARY'), 0) AS discretionary_cents FROM s GROUP BY 1),
    plan AS (SELECT coalesce(w.owner_id, inc.owner_id) AS owner_id, coalesce(income_cents, 0) AS income_cents, coalesce(spend_cents, 0) AS spend_cents, coalesce(fp, 0) AS fp,
        coalesce(fixed_obligations_cents, 0) AS fixed_obligations_cents, coalesce(discretionary_cents, 0) AS discretionary_cents FROM w FULL JOIN inc USING (owner_id)),
    rated AS (SELECT *, income_cents - spend_cents AS net_cents, CASE WHEN income_cents > 0 THEN (income_cents - spend_cents) / CAST(income_cents AS DOUBLE) * 100 ELSE 0 END AS savings_rate FROM plan)"""


@query("owner_id income_cents spend_cents net_cents fixed_obligations_cents discretionary_cents savings_rate:real health_score:real", _PLAN + """
    SELECT *, ((CASE WHEN savings_rate >= 20 THEN 1.0 WHEN savings_rate >= 10 THEN 0.7 WHEN savings_rate >= 0 THEN 0.4 ELSE 0.1 END) + fp) / 2 AS health_score FROM rated""")
def spending_plan(x: Inputs) -> DataFrame:
    return planner.budget_plan(_bucketed(x))


@query("owner_id month:text projected_income_cents projected_fixed_cents projected_net_cents", _PLAN + """
    SELECT owner_id, strftime(DATE '2001-11-01' + CAST(i * 30 AS INT), '%Y-%m') AS month, income_cents AS projected_income_cents,
        fixed_obligations_cents AS projected_fixed_cents, net_cents AS projected_net_cents FROM rated CROSS JOIN range(0, 3) AS t(i)""")
def budget_projection(x: Inputs) -> DataFrame:
    return planner.budget_projection(spending_plan(x), x.as_of)


@query("owner_id place merchant_norm:text monthly_cents total_cents row_count active_months", _BUCKETED + """,
    t AS (SELECT owner_id, count(DISTINCT month) AS months FROM b WHERE bucket = 'DISCRETIONARY' GROUP BY 1),
    d AS (SELECT owner_id, merchant_norm, sum(-amount_cents) AS total_cents, count(*) AS row_count, count(DISTINCT month) AS active_months FROM b WHERE bucket = 'DISCRETIONARY' GROUP BY 1, 2)
    SELECT d.*, total_cents // months AS monthly_cents, row_number() OVER (PARTITION BY owner_id ORDER BY total_cents // months DESC, merchant_norm) AS place
    FROM d JOIN t USING (owner_id) QUALIFY place <= 50""")
def bucket_merchants(x: Inputs) -> DataFrame:
    return planner.bucket_merchants(_bucketed(x), "DISCRETIONARY")


@query("owner_id month:text amount_cents", _BUCKETED + " SELECT owner_id, CAST(month AS DATE) AS month, cents AS amount_cents FROM mon WHERE bucket = 'FIXED_OBLIGATIONS'")
def bucket_months(x: Inputs) -> DataFrame:
    return planner.bucket_months(_bucketed(x), "FIXED_OBLIGATIONS")


_NEXT_MONTHLY = (f"(last_seen + to_months(CAST(greatest(1, (year({k.AS_OF}) - year(last_seen)) * 12 + month({k.AS_OF}) - month(last_seen)) "
                 f"+ CASE WHEN last_seen + to_months(CAST(greatest(1, (year({k.AS_OF}) - year(last_seen)) * 12 + month({k.AS_OF}) - month(last_seen)) AS INT)) < {k.AS_OF} THEN 1 ELSE 0 END AS INT)))")
_UPCOMING = f"""WITH {_FIRST.replace("recurring_overrides", "(SELECT * FROM recurring_overrides WHERE FALSE)")},
        {_SECOND.replace("recurring_overrides", "(SELECT * FROM recurring_overrides WHERE FALSE)")}, {_BILLS},
    subs AS (SELECT owner_id, merchant_norm, charge_cents AS cents, cadence, last_seen, CASE WHEN display_name IS NULL THEN 0.7 ELSE 0.9 END AS confidence, 'subscription' AS source FROM first
        UNION ALL SELECT owner_id, merchant_norm, cents, cadence, last_seen, 0.9, 'subscription' FROM second),
    guess AS (SELECT owner_id, merchant_norm, cents, confidence, source, CAST(CASE cadence
            WHEN 'annual' THEN CASE WHEN last_seen + to_years(1) >= {k.AS_OF} THEN last_seen + to_years(1) ELSE last_seen + to_years(2) END
            WHEN 'weekly' THEN {k.AS_OF} + CAST(7 - ({k.AS_OF} - last_seen) % 7 AS INT) WHEN 'biweekly' THEN {k.AS_OF} + CAST(14 - ({k.AS_OF} - last_seen) % 14 AS INT)
            WHEN 'quarterly' THEN last_seen + CAST(90 * greatest(1, ceil(({k.AS_OF} - last_seen) / 90.0)) AS INT) ELSE {_NEXT_MONTHLY} END AS DATE) AS due FROM subs
        UNION ALL SELECT owner_id, merchant_norm, monthly_cents, 0.6, 'bill', CAST({_NEXT_MONTHLY} AS DATE) FROM bills),
    up AS (SELECT * FROM guess WHERE due BETWEEN {k.AS_OF} AND {k.AS_OF} + 30)"""


@query("owner_id merchant_norm:text expected_date:text amount_cents confidence:real source:text",
       _UPCOMING + " SELECT owner_id, merchant_norm, due AS expected_date, cents AS amount_cents, confidence, source FROM up")
def upcoming_charges(x: Inputs) -> DataFrame:
    subs = rec.subscriptions(x.last_400_days, x.as_of, patterns=x.patterns)
    return planner.upcoming_charges(None, subs, rec.bills(x.patterns), x.as_of)


_CHARGES = f"""
    WITH plan AS ({_BOARD} SELECT * FROM board WHERE status = 'confirmed' AND direction = 'expense' AND resolved_cents IS NOT NULL), {_UPCOMING.removeprefix('WITH ')}
    SELECT owner_id, lower(coalesce(nullif(merchant_norm, ''), name)) AS merchant_norm, next_due AS expected_date, resolved_cents AS amount_cents, 1.0 AS confidence, 'commitment' AS source
    FROM plan WHERE next_due BETWEEN {k.AS_OF} AND {k.AS_OF} + 30
    UNION ALL SELECT owner_id, merchant_norm, due, cents, confidence, source FROM up
    WHERE NOT EXISTS (SELECT 1 FROM plan WHERE plan.owner_id = up.owner_id AND lower(plan.merchant_norm) = up.merchant_norm AND plan.merchant_norm <> '')"""


@query("owner_id merchant_norm:text expected_date:text amount_cents confidence:real source:text", _CHARGES)
def upcoming_charges_with_commitments(x: Inputs) -> DataFrame:
    subs = rec.subscriptions(x.last_400_days, x.as_of, patterns=x.patterns)
    return planner.upcoming_charges(x.board, subs, rec.bills(x.patterns), x.as_of)


def _flow(x: Inputs, charges: DataFrame) -> DataFrame:
    reports = pr.period_reports(x.month_totals, x.accounts, x.as_of, 3)
    plan = planner.budget_plan(planner.bucketed_rows(x.last_400_days, x.as_of, 3))
    return planner.cash_flow(charges, planner.income_estimate(reports, commitment_totals(x)), planner.flexible_estimate(plan))


_INCOME = _BOARD + f""", {_CONFIRMED},
    mean AS (SELECT owner_id, CAST(trunc(sum(income_cents) / CAST(sum(CAST(period_start + INTERVAL 1 MONTH AS DATE) - period_start) AS DOUBLE) * 30) AS BIGINT) AS m
        FROM reports WHERE period_start >= DATE '2001-09-01' GROUP BY owner_id)
    SELECT m.owner_id, CASE WHEN s.income_cents > 0 THEN CAST(trunc(s.income_cents * 30 / 30) AS BIGINT) ELSE m.m END AS expected_income_cents
    FROM mean m LEFT JOIN sure s USING (owner_id)"""
_FLOW = f"""
    WITH charge AS ({_CHARGES}), income AS ({_INCOME}),
    flexible AS ({_bucketed_check(3)}, inc AS (SELECT DISTINCT owner_id FROM r WHERE kind = 'INCOME')
        SELECT owner_id, coalesce(max(monthly_avg_cents) FILTER (WHERE bucket = 'VARIABLE_ESSENTIALS'), 0) AS variable, coalesce(max(monthly_avg_cents) FILTER (WHERE bucket = 'DISCRETIONARY'), 0) AS discretionary
        FROM s FULL JOIN inc USING (owner_id) GROUP BY owner_id),
    fixed AS (SELECT owner_id, sum(amount_cents) AS cents, avg(confidence) AS confidence FROM charge GROUP BY owner_id),
    parts AS (SELECT owner_id, coalesce(expected_income_cents, 0) AS expected_income_cents, coalesce(cents, 0) AS expected_fixed_cents, coalesce(variable, 0) AS expected_variable_cents,
        coalesce(discretionary, 0) AS expected_discretionary_cents, coalesce(confidence, 0.5) AS confidence
        FROM income FULL JOIN flexible USING (owner_id) FULL JOIN fixed USING (owner_id)),
    flow AS (SELECT *, expected_income_cents - expected_fixed_cents - expected_variable_cents - expected_discretionary_cents AS expected_net_cents FROM parts)"""


@query("owner_id expected_income_cents expected_fixed_cents expected_variable_cents expected_discretionary_cents expected_net_cents confidence:real", _FLOW + " SELECT * FROM flow")
def cash_flow_projection(x: Inputs) -> DataFrame:
    return _flow(x, cut_lineage(upcoming_charges_with_commitments(x)))


@query("owner_id expected_income_cents", _INCOME)
def income_estimate(x: Inputs) -> DataFrame:
    reports = pr.period_reports(x.month_totals, x.accounts, x.as_of, 3)
    return planner.income_estimate(reports, commitment_totals(x))


@query("owner_id alert_type:text severity:text alert_date:text amount_cents merchant_norm:text", _FLOW + f""",
    fit AS (SELECT * FROM flow WHERE confidence >= 0.5), judged AS (SELECT c.*, expected_income_cents FROM charge c JOIN fit USING (owner_id))
    SELECT owner_id, 'low_confidence' AS alert_type, 'low' AS severity, {k.AS_OF} AS alert_date, NULL AS amount_cents, NULL AS merchant_norm FROM flow WHERE confidence < 0.5
    UNION ALL SELECT owner_id, 'shortfall', CASE WHEN expected_net_cents < -50000 THEN 'high' ELSE 'medium' END, {k.AS_OF} + 30, expected_net_cents, NULL FROM fit WHERE expected_net_cents < 0
    UNION ALL SELECT owner_id, 'large_charge', 'medium', expected_date, amount_cents, merchant_norm FROM judged
        WHERE expected_income_cents > 0 AND amount_cents * 100 / CAST(expected_income_cents AS DOUBLE) > 20
    UNION ALL SELECT owner_id, 'multiple_charges', 'low', expected_date, sum(amount_cents), NULL FROM judged GROUP BY owner_id, expected_date HAVING count(*) >= 3""")
def cash_flow_alerts(x: Inputs) -> DataFrame:
    charges = cut_lineage(upcoming_charges_with_commitments(x))
    month = x.month_totals.filter("period_start = DATE '2001-11-01'")
    return planner.cash_flow_alerts(cut_lineage(_flow(x, charges)), charges, pr.integrity(month), x.as_of)
