"""Queries: transfer pairs, refunds, cross-account duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lexicon.categories import NOT_SPENDING, REFUNDABLE
from ..operators import detectors as det
from ..operators import pairing, refunds
from ..plans import period_report as pr
from ..session import store
from . import check_sql as k
from .registry import REPORTED, Inputs, query

_WORDS = (f"({k.has_any('merchant_norm', k.kw.PAIR_TRANSFER)} OR {k.whole_word('merchant_norm', k.kw.PAIR_BANK)} "
          f"OR {k.has_any('merchant_norm', k.kw.PAIR_CARD_PAYMENT)})")
_LOTS = f"""WITH legs AS (SELECT owner_id, account_id, posted_at, abs(amount_cents) AS cents, amount_cents < 0 AS out, {_WORDS} AS worded FROM posted WHERE amount_cents <> 0),
    lots AS MATERIALIZED (SELECT owner_id, account_id, posted_at, cents, out, worded, count(*) AS n FROM legs GROUP BY ALL),
    days AS (SELECT *, posted_at + CAST(d AS INT) AS near_day, cents // 301 + b AS near_band FROM lots, unnest([-3, -2, -1, 0, 1, 2, 3]) AS u(d), unnest([-1, 0, 1]) AS v(b) WHERE out),
    ins AS (SELECT *, cents // 301 AS band FROM lots WHERE NOT out),
    near AS (SELECT o.owner_id, o.account_id AS out_account_id, i.account_id AS in_account_id, o.posted_at AS out_posted_at, i.posted_at AS in_posted_at,
        o.cents AS out_cents, i.cents AS in_cents, o.n AS out_n, i.n AS in_n, abs(o.d) AS days_apart, abs(o.cents - i.cents) AS cents_apart,
        o.worded AS out_worded, i.worded AS in_worded
        FROM days o JOIN ins i ON o.owner_id = i.owner_id AND o.near_day = i.posted_at AND o.near_band = i.band WHERE o.account_id <> i.account_id AND abs(o.cents - i.cents) <= 300)"""


@query("owner_id out_account_id:text in_account_id:text out_posted_at:text in_posted_at:text out_cents in_cents out_n in_n score:real", _LOTS + """
    SELECT * FROM (SELECT *, (1.0 - days_apart / 4.0) * 0.4 + (1.0 - cents_apart / 301.0) * 0.6 + CASE WHEN cents_apart = 0 THEN 0.2 ELSE 0 END
        + CASE WHEN days_apart = 0 THEN 0.1 ELSE 0 END + CASE WHEN out_worded OR in_worded THEN 0.15 ELSE 0 END
        + CASE WHEN out_worded AND in_worded THEN 0.1 ELSE 0 END AS score FROM near) AS s
    WHERE score >= CASE WHEN out_worded THEN 0.5 ELSE 0.7 END""")
def transfer_candidates(x: Inputs) -> DataFrame:
    return pairing.scored(pairing.pair_candidates(x.ledger))


# The serial search: candidate rows in order of their proposers, each taken if neither side is taken yet.
_GREEDY = "list_reduce(list(ends ORDER BY turn), lambda taken, pair: CASE WHEN list_has_any(taken, pair) THEN taken ELSE list_concat(taken, pair) END)"


def _taken(rows: str, *turn: str) -> str:
    """Pairs (owner_id, first_fp, second_fp) of a serial search over `rows`, which has both fingerprints and what `turn` orders by."""
    return f"""turns AS (SELECT owner_id, ['1' || first_fp, '2' || second_fp] AS ends, row_number() OVER (PARTITION BY owner_id ORDER BY {', '.join(turn)}) AS turn FROM {rows}),
    kept AS (SELECT owner_id, {_GREEDY} AS t FROM turns GROUP BY owner_id),
    won AS (SELECT owner_id, substr(t[k], 2) AS first_fp, substr(t[k + 1], 2) AS second_fp FROM kept, unnest(range(1, len(t), 2)) AS u(k))"""


def _pairs(score: str, least: str, words: str = _WORDS, tolerance: int = 300) -> str:
    lots = _LOTS.replace(_WORDS, words).replace("<= 300)", f"<= {tolerance})")
    placed = f"""placed AS (SELECT owner_id, account_id, posted_at, abs(amount_cents) AS cents, amount_cents < 0 AS out, {words} AS worded, fingerprint,
        row_number() OVER (PARTITION BY owner_id, account_id, posted_at, amount_cents, {words} ORDER BY md5(fingerprint), fingerprint) AS place FROM posted WHERE amount_cents <> 0),
    judged AS (SELECT * FROM (SELECT *, {score} AS score FROM near) AS s WHERE {least}),
    choices AS (SELECT j.*, o.fingerprint AS first_fp, i.fingerprint AS second_fp, o.place AS out_place, i.place AS in_place FROM judged j
        JOIN placed o ON o.owner_id = j.owner_id AND o.account_id = out_account_id AND o.posted_at = out_posted_at AND o.cents = out_cents AND o.out AND o.worded = out_worded
        JOIN placed i ON i.owner_id = j.owner_id AND i.account_id = in_account_id AND i.posted_at = in_posted_at AND i.cents = in_cents AND NOT i.out AND i.worded = in_worded)"""
    taken = _taken("choices", "out_posted_at", "out_cents DESC", "out_account_id", "out_worded", "out_place", "score DESC", "in_posted_at", "in_cents DESC",
                   "in_account_id", "in_worded", "in_place")
    return f"""{lots}, {placed}, {taken},
    pairs AS (SELECT c.*, left(sha256(c.owner_id || '|' || first_fp || '|' || second_fp), 16) AS pair_id FROM won JOIN choices c USING (owner_id, first_fp, second_fp))"""


_SCORE = """(CAST(1 AS DOUBLE) - days_apart / CAST(4 AS DOUBLE)) * CAST(0.4 AS DOUBLE) + (CAST(1 AS DOUBLE) - cents_apart / CAST(301 AS DOUBLE)) * CAST(0.6 AS DOUBLE)
    + CAST(CASE WHEN cents_apart = 0 THEN 0.2 ELSE 0 END AS DOUBLE) + CAST(CASE WHEN days_apart = 0 THEN 0.1 ELSE 0 END AS DOUBLE)
    + CAST(CASE WHEN out_worded OR in_worded THEN 0.15 ELSE 0 END AS DOUBLE) + CAST(CASE WHEN out_worded AND in_worded THEN 0.1 ELSE 0 END AS DOUBLE)"""
_PAIRS = _pairs(_SCORE, "score >= CAST(CASE WHEN out_worded THEN 0.5 ELSE 0.7 END AS DOUBLE)")


@query("owner_id pair_id:text out_fingerprint:text in_fingerprint:text confidence:real match_reason:text amount_diff_cents net_cents", _PAIRS + """
    SELECT owner_id, pair_id, first_fp AS out_fingerprint, second_fp AS in_fingerprint, least(1, score) AS confidence, cents_apart AS amount_diff_cents, in_cents - out_cents AS net_cents,
        CASE WHEN cents_apart = 0 THEN 'exact amount' ELSE '±$' || format('{:,.2f}', cents_apart / 100.0) END || ', '
            || CASE days_apart WHEN 0 THEN 'same day' WHEN 1 THEN '1 day apart' ELSE days_apart || ' days apart' END AS match_reason FROM pairs""")
def transfer_pairs(x: Inputs) -> DataFrame:
    return pairing.transfer_pairs(x.ledger)


@query("owner_id pair_id:text fingerprint:text partner_fingerprint:text status:text", _PAIRS + """,
    stated AS (SELECT *, CASE WHEN score >= 0.8 THEN 'MATCHED' ELSE 'SUSPECTED' END AS status FROM pairs)
    SELECT owner_id, pair_id, first_fp AS fingerprint, second_fp AS partner_fingerprint, status FROM stated
    UNION ALL SELECT owner_id, pair_id, second_fp, first_fp, status FROM stated""")
def transfer_pair_legs(x: Inputs) -> DataFrame:
    return pairing.pair_legs(pairing.transfer_pairs(x.ledger))


@query("owner_id pair_id:text out_account_id:text in_account_id:text", _PAIRS + """
    SELECT owner_id, pair_id, out_account_id, in_account_id FROM pairs WHERE NOT ends_with(out_account_id, '-2') AND NOT ends_with(in_account_id, '-2')""")
def visible_transfer_pairs(x: Inputs) -> DataFrame:
    """Pairs left when the second accounts are not chosen: both legs must be among the chosen ones."""
    chosen = x.accounts.filter("not endswith(account_id, '-2')").select("account_id")
    return pairing.visible_pairs(pairing.transfer_pairs(x.ledger), chosen)


_LIKE = f"({k.has_any('merchant_norm', k.kw.PATTERN_TRANSFER)} OR {k.has_any('merchant_norm', k.kw.CREDIT_TRANSFER)})"


@query("owner_id out_fingerprint:text in_fingerprint:text",
       _pairs("CAST(0 AS DOUBLE)", "out_worded OR in_worded", _LIKE, 100) + " SELECT owner_id, first_fp AS out_fingerprint, second_fp AS in_fingerprint FROM pairs")
def first_fit_transfer_pairs(x: Inputs) -> DataFrame:
    return pairing.first_fit_pairs(x.ledger)


@query("owner_id unpaired_count unpaired_worded_count unpaired_cents", _PAIRS + """,
    ends AS (SELECT owner_id, first_fp AS fingerprint FROM pairs UNION SELECT owner_id, second_fp FROM pairs)
    SELECT owner_id, count(*) AS unpaired_count, count(CASE WHEN worded THEN 1 END) AS unpaired_worded_count, sum(cents) AS unpaired_cents FROM placed
    WHERE NOT EXISTS (SELECT 1 FROM ends e WHERE e.owner_id = placed.owner_id AND e.fingerprint = placed.fingerprint) GROUP BY owner_id""", read=REPORTED)
def unmatched_transfer_legs(x: Inputs) -> DataFrame:
    legs = pairing.unmatched_legs(x.ledger, store(pairing.transfer_pairs(x.ledger, stored=True)))
    return legs.groupBy("owner_id").agg(
        F.count("*").alias("unpaired_count"), F.count_if("worded").alias("unpaired_worded_count"), F.sum("cents").alias("unpaired_cents"))


_REFUND_LOTS = f"""WITH names AS (SELECT merchant_norm, list_filter(regexp_split_to_array(merchant_norm, '[\\s._-]+'), lambda w: length(w) > 2)[1] AS word
        FROM (SELECT DISTINCT merchant_norm FROM posted)),
    links AS (SELECT a.merchant_norm AS r, b.merchant_norm AS e FROM names a JOIN names b ON a.merchant_norm <> '' AND b.merchant_norm <> ''
        AND (contains(a.merchant_norm, b.merchant_norm) OR contains(b.merchant_norm, a.merchant_norm) OR a.word = b.word)),
    refs AS (SELECT DISTINCT owner_id, merchant_norm, posted_at, amount_cents AS cents, {k.has_any('merchant_norm', k.kw.MATCH_REFUND)} AS worded FROM posted WHERE amount_cents > 0),
    exps AS (SELECT DISTINCT owner_id, merchant_norm, posted_at, -amount_cents AS cents FROM posted WHERE amount_cents < 0),
    near AS (SELECT r.owner_id, r.merchant_norm AS refund_merchant_norm, e.merchant_norm AS expense_merchant_norm, r.posted_at AS refund_posted_at, e.posted_at AS expense_posted_at,
        r.cents AS refund_cents, e.cents AS expense_cents, l.r IS NOT NULL AS same, r.worded, r.posted_at - e.posted_at AS days, abs(r.cents - e.cents) / CAST(e.cents AS DOUBLE) * 100 AS off
        FROM refs r JOIN exps e ON r.owner_id = e.owner_id AND r.posted_at - e.posted_at BETWEEN 0 AND 90 AND r.cents <= e.cents + floor(e.cents * 5.0 / 100)
        LEFT JOIN links l ON l.r = r.merchant_norm AND l.e = e.merchant_norm WHERE l.r IS NOT NULL OR r.worded),
    found AS (SELECT * FROM (SELECT *, CAST(CASE WHEN same THEN 0.4 ELSE 0 END AS DOUBLE) + CAST(CASE WHEN worded THEN 0.2 ELSE 0 END AS DOUBLE)
        + CAST(CASE WHEN off < 1 THEN 0.3 WHEN off < 5 THEN 0.2 WHEN off < 20 THEN 0.1 ELSE 0 END AS DOUBLE)
        + CAST(CASE WHEN days <= 7 THEN 0.1 WHEN days <= 30 THEN 0.05 ELSE 0 END AS DOUBLE) AS score FROM near) AS s WHERE score >= CAST(0.4 AS DOUBLE))"""


@query("owner_id refund_merchant_norm:text expense_merchant_norm:text refund_posted_at:text expense_posted_at:text refund_cents expense_cents score:real",
       _REFUND_LOTS + " SELECT * FROM found")
def refund_candidates(x: Inputs) -> DataFrame:
    return refunds.refund_candidates(*refunds.stored_rows(x.ledger))


_MATCHES = f"""{_REFUND_LOTS},
    placed AS (SELECT owner_id, merchant_norm, posted_at, amount_cents, fingerprint,
        row_number() OVER (PARTITION BY owner_id, merchant_norm, posted_at, amount_cents ORDER BY md5(fingerprint), fingerprint) AS place FROM posted WHERE amount_cents <> 0),
    choices AS (SELECT f.*, r.fingerprint AS first_fp, e.fingerprint AS second_fp, r.place AS refund_place, e.place AS expense_place FROM found f
        JOIN placed r ON r.owner_id = f.owner_id AND r.merchant_norm = refund_merchant_norm AND r.posted_at = refund_posted_at AND r.amount_cents = refund_cents
        JOIN placed e ON e.owner_id = f.owner_id AND e.merchant_norm = expense_merchant_norm AND e.posted_at = expense_posted_at AND e.amount_cents = -expense_cents),
    {_taken('choices', 'refund_posted_at DESC', 'refund_merchant_norm', 'refund_cents', 'refund_place', 'score DESC', 'expense_posted_at DESC', 'expense_merchant_norm',
            'expense_cents', 'expense_place')},
    matches AS (SELECT c.* FROM won JOIN choices c USING (owner_id, first_fp, second_fp))"""


@query("owner_id refund_fingerprint:text expense_fingerprint:text refund_amount_cents expense_amount_cents days_apart confidence:real match_reason:text is_full_refund:flag", _MATCHES + """
    SELECT owner_id, first_fp AS refund_fingerprint, second_fp AS expense_fingerprint, refund_cents AS refund_amount_cents, -expense_cents AS expense_amount_cents, days AS days_apart,
        score AS confidence, CASE WHEN worded THEN 'refund keyword, ' ELSE '' END || CASE days WHEN 0 THEN 'same day' ELSE days || 'd apart' END AS match_reason,
        refund_cents >= expense_cents AS is_full_refund FROM matches""", read=REPORTED)
def refund_matches(x: Inputs) -> DataFrame:
    return refunds.refund_matches(x.ledger, stored=True)


@query("owner_id refund_fingerprint:text expense_fingerprint:text status:text", _MATCHES + f"""
    SELECT owner_id, first_fp AS refund_fingerprint, second_fp AS expense_fingerprint, CASE WHEN score >= {refunds.CONFIDENT} THEN 'MATCHED' ELSE 'SUSPECTED' END AS status FROM matches""", read=REPORTED)
def refund_table(x: Inputs) -> DataFrame:
    return refunds.refund_table(refunds.refund_matches(x.ledger, stored=True))


@query("owner_id fingerprint:text cents", _MATCHES + f"""
    SELECT owner_id, fingerprint, amount_cents AS cents FROM posted p WHERE amount_cents > 0 AND {k.has_any('merchant_norm', k.kw.MATCH_REFUND)}
        AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.owner_id = p.owner_id AND m.first_fp = p.fingerprint)""", read=REPORTED)
def unmatched_refunds(x: Inputs) -> DataFrame:
    return refunds.unmatched_refunds(x.ledger, store(refunds.refund_matches(x.ledger, stored=True)))


_FOUND = k.category("lower(merchant_norm || ' ' || coalesce(description, ''))")


@query("owner_id category:text gross_cents refund_cents net_cents", _MATCHES + f""",
    judged AS (SELECT owner_id, date_trunc('month', posted_at) AS month, amount_cents, fingerprint, {_FOUND} AS found FROM norm),
    named AS (SELECT *, CASE WHEN amount_cents <= 0 OR found IN {k.names(REFUNDABLE)} OR found = 'income' THEN found ELSE 'one_time_deposit' END AS category FROM judged),
    monthly AS (SELECT owner_id, category, sum(CASE WHEN amount_cents < 0 THEN -amount_cents ELSE 0 END) AS spent, sum(CASE WHEN amount_cents > 0 THEN amount_cents ELSE 0 END) AS back
        FROM named WHERE category NOT IN {k.names(NOT_SPENDING)} GROUP BY owner_id, month, category HAVING spent > 0 OR back > 0),
    gross AS (SELECT owner_id, category, sum(spent) AS gross_cents FROM monthly GROUP BY 1, 2),
    paid AS (SELECT m.owner_id, found AS category, sum(refund_cents) AS refund_cents FROM matches m JOIN judged j ON j.owner_id = m.owner_id AND j.fingerprint = m.second_fp GROUP BY 1, 2)
    SELECT g.owner_id, g.category, gross_cents, coalesce(refund_cents, 0) AS refund_cents, gross_cents - coalesce(refund_cents, 0) AS net_cents
    FROM gross g LEFT JOIN paid p ON p.owner_id = g.owner_id AND p.category = g.category""", read=REPORTED)
def category_net_of_refunds(x: Inputs) -> DataFrame:
    gross = pr.scan_breakdown(pr.scan_categories(x.stored)).groupBy("owner_id", "category").agg(F.sum("gross_cents").alias("gross_cents"))
    return refunds.category_net_of_refunds(gross, store(refunds.refund_matches(x.stored, stored=True)), x.stored)


@query("owner_id amount_cents account_1:text account_2:text date_1:text date_2:text merchant_1:text merchant_2:text similarity:real account_1_name:text", f"""
    WITH d AS (SELECT DISTINCT owner_id, amount_cents, account_id, posted_at, merchant_norm FROM norm WHERE posted_at BETWEEN {k.AS_OF} - 60 AND {k.AS_OF}),
    p AS (SELECT a.owner_id, a.amount_cents, a.account_id AS account_1, b.account_id AS account_2, a.posted_at AS date_1, b.posted_at AS date_2,
        a.merchant_norm AS merchant_1, b.merchant_norm AS merchant_2, list_distinct(regexp_split_to_array(a.merchant_norm, '\\s+')) AS w1, list_distinct(regexp_split_to_array(b.merchant_norm, '\\s+')) AS w2
        FROM d a JOIN d b ON a.owner_id = b.owner_id AND a.amount_cents = b.amount_cents AND a.account_id <> b.account_id AND b.posted_at - a.posted_at BETWEEN 0 AND 2
        AND (a.posted_at < b.posted_at OR a.account_id < b.account_id)),
    s AS (SELECT *, CASE WHEN merchant_1 = '' OR merchant_2 = '' THEN 0 WHEN merchant_1 = merchant_2 THEN 1 WHEN contains(merchant_1, merchant_2) OR contains(merchant_2, merchant_1) THEN 0.9
        WHEN len(list_intersect(w1, w2)) > 0 THEN 0.5 + 0.4 * len(list_intersect(w1, w2)) / CAST(len(list_distinct(list_concat(w1, w2))) AS DOUBLE)
        WHEN length(split_part(merchant_1, ' ', 1)) > 3 AND length(split_part(merchant_2, ' ', 1)) > 3 AND left(merchant_1, 4) = left(merchant_2, 4) THEN 0.5 ELSE 0 END AS similarity FROM p)
    SELECT s.*, a.name AS account_1_name FROM s JOIN accounts a ON a.account_id = account_1 WHERE similarity >= 0.3
    QUALIFY row_number() OVER (PARTITION BY s.owner_id, amount_cents, account_1, date_1, account_2, date_2 ORDER BY merchant_1, merchant_2) = 1""")
def cross_account_duplicates(x: Inputs) -> DataFrame:
    return det.cross_account_duplicates(x.ledger, x.accounts, x.as_of)


# --- the same searches within each month, as a month's report sees them -----------------

_MONTH_KEY = "owner_id || '#' || CAST(CAST(date_trunc('month', posted_at) AS DATE) AS VARCHAR)"
_KEYED = f"keyed AS (SELECT * REPLACE ({_MONTH_KEY} AS owner_id) FROM posted)"
_SERVED = """served AS (SELECT p.* REPLACE (p.owner_id || '#' || CAST(CAST(m AS DATE) AS VARCHAR) AS owner_id) FROM posted p,
    unnest(generate_series(CAST(date_trunc('month', posted_at) AS TIMESTAMP), CAST(posted_at + 90 AS TIMESTAMP), INTERVAL 1 MONTH)) AS u(m) WHERE amount_cents < 0)"""
MONTH_PAIRS = _PAIRS.replace("WITH legs", f"WITH {_KEYED}, legs").replace("FROM posted WHERE", "FROM keyed WHERE")
_MONTH_MATCHES = (
    _MATCHES.replace("WITH names", f"WITH {_KEYED}, {_SERVED}, sides AS (SELECT * FROM keyed WHERE amount_cents > 0 UNION ALL SELECT * FROM served), names")
    .replace("FROM posted WHERE amount_cents > 0)", "FROM keyed WHERE amount_cents > 0)").replace("FROM posted WHERE amount_cents < 0)", "FROM served)")
    .replace("FROM posted WHERE amount_cents <> 0)", "FROM sides)"))
MONTH_LEGS = f"""({MONTH_PAIRS} SELECT CAST(split_part(owner_id, '#', 1) AS BIGINT) AS owner_id, first_fp AS fingerprint FROM pairs
    UNION SELECT CAST(split_part(owner_id, '#', 1) AS BIGINT), second_fp FROM pairs)"""
MONTH_REFUNDS = f"({_MONTH_MATCHES} SELECT DISTINCT CAST(split_part(owner_id, '#', 1) AS BIGINT) AS owner_id, first_fp AS fingerprint FROM matches)"
