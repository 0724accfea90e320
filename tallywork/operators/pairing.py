"""Transfer pairing: money that leaves one account and reaches another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..lexicon import keywords as kw
from ..session import store
from .classify import transfer_like
from .matching import assign, band, bands_near, day_number, expand, lot_id
from .scan import KEYS, posted_only, with_merchant_norm

MIN_SCORE, MIN_SCORE_PLAIN = 0.5, 0.7
CONFIDENT = 0.8


def has_transfer_words(m: Column) -> Column:
    return (
        text.contains_any(m, kw.PAIR_TRANSFER) | text.any_word(m, kw.PAIR_BANK) | text.contains_any(m, kw.PAIR_CARD_PAYMENT)
    )


def _legs(ledger: DataFrame, keys: Sequence[str], words) -> DataFrame:
    """Posted non-zero rows."""
    rows = with_merchant_norm(ledger.filter(posted_only() & (F.col("amount_cents") != 0)))
    return rows.select(
        *keys, "fingerprint", "account_id", "posted_at", F.abs("amount_cents").alias("cents"),
        (F.col("amount_cents") < 0).alias("is_outflow"), words(F.col("merchant_norm")).alias("worded"),
    )


# What rows of a lot share besides the ledger's keys.
_ALIKE = ["account_id", "posted_at", "cents", "worded"]


def _lots(legs: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    counted = legs.groupBy(*keys, *_ALIKE, "is_outflow").agg(F.count("*").alias("n"))

    def side(outflow: bool, name: str) -> DataFrame:
        return counted.filter(F.col("is_outflow") == outflow).select(
            *keys, *[F.col(c).alias(f"{name}_{c}") for c in (*_ALIKE, "n")])

    return side(True, "out"), side(False, "in")


def pair_candidates(
    ledger: DataFrame,
    tolerance_days: int = 3,
    tolerance_cents: int = 300,
    keys: Sequence[str] = KEYS,
    words=has_transfer_words,
) -> DataFrame:
    """Candidates of a ledger, see lot_candidates."""
    return lot_candidates(_legs(ledger, keys, words), tolerance_days, tolerance_cents, keys)


def lot_candidates(legs: DataFrame, tolerance_days: int, tolerance_cents: int, keys: Sequence[str]) -> DataFrame:
    """Lots of outflows and inflows close in date and amount, on different accounts of one ledger.

    Joined on bands of days and cents, so a lot meets a bounded neighbourhood.
    """
    out, into = _lots(legs, keys)
    day_width, cent_width = 2 * tolerance_days + 1, 2 * tolerance_cents + 1
    out = out.withColumn("day_band", band(day_number(F.col("out_posted_at")), day_width)).withColumn(
        "cent_band", band(F.col("out_cents"), cent_width)
    )
    into = into.withColumn(
        "day_band", F.explode(bands_near(day_number(F.col("in_posted_at")), tolerance_days, day_width))
    ).withColumn("cent_band", F.explode(bands_near(F.col("in_cents"), tolerance_cents, cent_width)))
    days = F.abs(F.datediff("out_posted_at", "in_posted_at"))
    cents = F.abs(F.col("out_cents") - F.col("in_cents"))
    return (
        out.join(into, [*keys, "day_band", "cent_band"])
        .filter((days <= tolerance_days) & (cents <= tolerance_cents) & (F.col("out_account_id") != F.col("in_account_id")))
        .withColumn("days_apart", days)
        .withColumn("cents_apart", cents)
        .withColumns({f"{side}_lot": lot_id(*keys, *[f"{side}_{c}" for c in _ALIKE]) for side in ("out", "in")})
        .drop("day_band", "cent_band")
    )


def scored(candidates: DataFrame, tolerance_days: int = 3, tolerance_cents: int = 300) -> DataFrame:
    """Adds score, keeps what reaches the outflow's threshold."""
    days, cents = F.col("days_apart"), F.col("cents_apart")
    out_words, in_words = F.col("out_worded"), F.col("in_worded")

    def bonus(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))

    score = (
        (F.lit(1.0) - days / F.lit(tolerance_days + 1)) * 0.4
        + (F.lit(1.0) - cents / F.lit(tolerance_cents + 1)) * 0.6
        + bonus(cents == 0, 0.2)
        + bonus(days == 0, 0.1)
        + bonus(out_words | in_words, 0.15)
        + bonus(out_words & in_words, 0.1)
    )
    needed = F.when(out_words, F.lit(MIN_SCORE)).otherwise(F.lit(MIN_SCORE_PLAIN))
    return candidates.withColumn("score", score).filter(F.col("score") >= needed)


def _leg_order(side: str) -> Column:
    """Date, larger amount first; account and wording settle ties."""
    return F.struct(
        F.col(f"{side}_posted_at"), -F.col(f"{side}_cents"), F.col(f"{side}_account_id"), F.col(f"{side}_worded"),
        F.col(f"{side}_lot"),
    )


def _pair_rows(candidates: DataFrame, score: Column, legs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matched rows with the lot figures of their candidate."""
    candidates = store(candidates)
    pairs = candidates.select(
        *keys, F.col("out_lot").alias("proposer"), F.col("in_lot").alias("partner"),
        F.col("out_n").alias("proposer_n"), F.col("in_n").alias("partner_n"), score.alias("score"),
        _leg_order("in").alias("partner_order"), _leg_order("out").alias("proposer_order"),
    )
    settled = assign(pairs, F.col("score"), F.col("partner_order"), F.col("proposer_order"), keys)
    rows = legs.select("is_outflow", lot_id(*keys, *_ALIKE).alias("lot"), F.col("fingerprint").alias("row_id"))
    sides = (rows.filter(side).drop("is_outflow") for side in ("is_outflow", "not is_outflow"))
    matched = expand(settled, *sides).withColumnsRenamed({"proposer": "out_lot", "partner": "in_lot"})
    return matched.join(candidates, ["out_lot", "in_lot"])


def _reason(days: Column, cents: Column) -> Column:
    amount = F.when(cents == 0, F.lit("exact amount")).otherwise(
        F.concat(F.lit("±$"), F.format_number(cents / 100, 2)))
    when = (
        F.when(days == 0, F.lit("same day")).when(days == 1, F.lit("1 day apart"))
        .otherwise(F.concat(days.cast("string"), F.lit(" days apart")))
    )
    return F.concat_ws(", ", amount, when)


def transfer_pairs(
    ledger: DataFrame, tolerance_days: int = 3, tolerance_cents: int = 300, keys: Sequence[str] = KEYS, stored: bool = False
) -> DataFrame:
    """One row per pair: both fingerprints and accounts, amounts, confidence and reason.

    A ledger that is `stored` as a table is read again; of a view, the legs are written first."""
    legs = _legs(ledger, keys, has_transfer_words)
    legs = legs if stored else store(legs)
    found = scored(lot_candidates(legs, tolerance_days, tolerance_cents, keys), tolerance_days, tolerance_cents)
    rows = _pair_rows(found, F.col("score"), legs, keys)
    return rows.select(
        *keys,
        F.substring(F.sha2(F.concat_ws("|", *keys, "proposer_row", "partner_row"), 256), 1, 16).alias("pair_id"),
        F.col("proposer_row").alias("out_fingerprint"), F.col("partner_row").alias("in_fingerprint"),
        "out_account_id", "in_account_id", "out_posted_at", "in_posted_at",
        (-F.col("out_cents")).alias("out_amount_cents"), F.col("in_cents").alias("in_amount_cents"),
        F.least(F.lit(1.0), "score").alias("confidence"),
        _reason(F.col("days_apart"), F.col("cents_apart")).alias("match_reason"),
        F.col("cents_apart").alias("amount_diff_cents"),
        (F.col("in_cents") - F.col("out_cents")).alias("net_cents"),
    )


def first_fit_pairs(
    ledger: DataFrame, tolerance_days: int = 3, tolerance_cents: int = 100, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Fingerprints of pairs by the simple rule: the first free inflow in date order, one side worded like a transfer."""
    legs = store(_legs(ledger, keys, transfer_like))
    found = lot_candidates(legs, tolerance_days, tolerance_cents, keys).filter(F.col("out_worded") | F.col("in_worded"))
    rows = _pair_rows(found, F.lit(0.0), legs, keys)
    return rows.select(*keys, F.col("proposer_row").alias("out_fingerprint"), F.col("partner_row").alias("in_fingerprint"))


def visible_pairs(pairs: DataFrame, accounts: Sequence[str] | DataFrame | None) -> DataFrame:
    """Pairs of which both legs are in the chosen accounts: ids, or a table with account_id."""
    if accounts is None:
        return pairs
    if isinstance(accounts, DataFrame):
        for side in ("out_account_id", "in_account_id"):
            pairs = pairs.join(accounts.select(F.col("account_id").alias(side)), side, "left_semi")
        return pairs
    chosen = list(accounts)
    return pairs.filter(F.col("out_account_id").isin(chosen) & F.col("in_account_id").isin(chosen))


def pair_legs(pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Two rows per pair, the stored form: leg, other leg, status by confidence."""
    status = F.when(F.col("confidence") >= CONFIDENT, F.lit("MATCHED")).otherwise(F.lit("SUSPECTED"))

    def leg(side: str, other: str) -> DataFrame:
        return pairs.select(
            *keys, "pair_id", F.col(f"{side}_fingerprint").alias("fingerprint"),
            F.col(f"{other}_fingerprint").alias("partner_fingerprint"), F.lit(side == "out").alias("is_outflow"),
            "confidence", status.alias("status"))

    return leg("out", "in").unionByName(leg("in", "out"))


def unmatched_legs(ledger: DataFrame, pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Posted non-zero rows outside every pair; `worded` marks those that read like a transfer."""
    legs = _legs(ledger, keys, has_transfer_words)
    return legs.join(pair_legs(pairs, keys).select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_anti")
