"""Anomaly detectors. Each returns alerts with the same columns.

Copies of a charge are counted, not compared pair by pair, and a detector that
looks around a charge joins on days or bands, so a hot merchant spreads out.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..lexicon import keywords as kw
from .classify import first_family, is_pattern_transfer
from .matching import day_number
from .scan import KEYS, for_accounts_or_all, look_back, with_merchant_norm
from .stats import exact_median

# Fixed values of the detectors.
ROUND_CENTS = [5000, 10000, 15000, 20000, 25000]
SEVERITY = {
    "duplicate_charge": "high", "unusual_amount": "high", "test_charge": "medium",
    "round_amount_spike": "medium", "rapid_fire": "medium", "refund_recharge": "low",
}
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2}
RECHARGE_DAYS, RECHARGE_SHARE = 7, 0.2
CENT_BAND = math.log(1.25)


def _usd(cents: Column) -> Column:
    return F.concat(F.lit("$"), F.format_string("%.2f", cents / 100))


def _alert(rows: DataFrame, kind: str, detail: Column, keys: Sequence[str], related: str | None = None) -> DataFrame:
    return rows.select(
        *keys, "posted_at", "merchant_norm", "amount_cents", F.lit(kind).alias("pattern_type"),
        F.lit(SEVERITY[kind]).alias("severity"), detail.alias("detail"),
        (F.col(related) if related else F.lit(None).cast("date")).alias("related_date"),
        "account_name", "raw_description",
    )


def detector_rows(
    ledger: DataFrame,
    accounts_dim: DataFrame,
    as_of: str | dt.date,
    days: int = 60,
    accounts: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Rows the detectors read, pending ones included, with the account's name."""
    names = accounts_dim.select("account_id", F.col("name").alias("account_name"))
    rows = with_merchant_norm(for_accounts_or_all(look_back(ledger, as_of, days), accounts))
    return rows.join(names, "account_id", "left").select(
        *keys, "posted_at", "merchant_norm", "amount_cents", "account_name", "fingerprint",
        text.raw_description(F.col("merchant"), F.col("description")).alias("raw_description"),
    )


def duplicate_charges(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Same merchant, amount and account name one to three days apart; one alert per pair of days."""
    charge = [*keys, "merchant_norm", "amount_cents", "account_name"]
    per_day = rows.filter("amount_cents < 0").groupBy(*charge, "posted_at").agg(
        F.min("raw_description").alias("raw_description"))
    later = per_day.withColumn("first_day", F.explode(F.array(*[F.date_sub("posted_at", n) for n in (1, 2, 3)])))
    earlier = per_day.select(*keys, "merchant_norm", "amount_cents", F.col("account_name").alias("first_account"),
                             F.col("posted_at").alias("first_day"))
    pairs = (
        later.join(earlier, [*keys, "merchant_norm", "amount_cents", "first_day"])
        .filter(F.col("account_name").eqNullSafe(F.col("first_account")))
        .groupBy(*keys, "merchant_norm", "amount_cents", "posted_at", "first_day")
        .agg(F.min("account_name").alias("account_name"), F.min("raw_description").alias("raw_description"))
        .withColumn("amount_cents", F.abs("amount_cents"))
    )
    said = F.concat(F.lit("charged twice: "), _usd(F.col("amount_cents")), F.lit(" on "), F.col("first_day").cast("string"),
                    F.lit(" and "), F.col("posted_at").cast("string"))
    return _alert(pairs, "duplicate_charge", said, keys, "first_day")


def unusual_amounts(rows: DataFrame, patterns: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Charges over twice the merchant's median and over $20, with at least four charges on record."""
    usual = patterns.filter("occurrence_count >= 4 and median_amount_cents > 0").select(
        *keys, "merchant_norm", "median_amount_cents")
    found = (
        rows.filter("amount_cents < -2000").withColumn("amount_cents", F.abs("amount_cents"))
        .join(usual, [*keys, "merchant_norm"])
        .filter(F.col("amount_cents") > F.col("median_amount_cents") * 2)
    )
    said = F.concat(_usd(F.col("amount_cents")), F.lit(" is "),
                    F.format_string("%.1f", F.col("amount_cents") / F.col("median_amount_cents")),
                    F.lit("x the usual "), _usd(F.col("median_amount_cents")))
    return _alert(found, "unusual_amount", said, keys)


def test_charges(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Charges of one cent to one dollar."""
    found = rows.filter("amount_cents between -100 and -1").withColumn("amount_cents", F.abs("amount_cents"))
    return _alert(found, "test_charge", F.concat(F.lit("tiny charge, perhaps a card check: "), _usd(F.col("amount_cents"))), keys)


def round_first_charges(rows: DataFrame, patterns: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A new merchant whose first row in the window is a round charge."""
    merchant = [*keys, "merchant_norm"]
    known = patterns.filter("occurrence_count > 1").select(*merchant)
    order = F.struct("posted_at", "fingerprint")
    first = rows.groupBy(*merchant).agg(F.min_by(F.struct(
        "posted_at", "amount_cents", "account_name", "raw_description"), order).alias("first")).select(*merchant, "first.*")
    found = (
        first.filter(F.col("amount_cents").isin([-c for c in ROUND_CENTS]))
        .join(known, merchant, "left_anti").withColumn("amount_cents", F.abs("amount_cents"))
    )
    said = F.concat(F.lit("new merchant starts with a round $"), F.format_string("%.0f", F.col("amount_cents") / 100))
    return _alert(found, "round_amount_spike", said, keys)


def rapid_fire(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The first day of each merchant from which three or more charges fall within a day; the amount is their sum."""
    merchant = [*keys, "merchant_norm"]
    per_day = rows.filter("amount_cents < 0").groupBy(*merchant, "posted_at").agg(
        F.count("*").alias("n"), F.sum(F.abs("amount_cents")).alias("cents"),
        F.min_by(F.struct("account_name", "raw_description"), "fingerprint").alias("shown"))
    ahead = Window.partitionBy(*merchant).orderBy(day_number(F.col("posted_at"))).rangeBetween(0, 1)
    bursts = per_day.withColumn("charges", F.sum("n").over(ahead)).withColumn("total", F.sum("cents").over(ahead))
    found = (
        bursts.filter("charges >= 3").groupBy(*merchant)
        .agg(F.min_by(F.struct("posted_at", "charges", F.col("total").alias("amount_cents"), "shown"), "posted_at").alias("b"))
        .select(*merchant, "b.posted_at", "b.charges", "b.amount_cents", "b.shown.*")
    )
    said = F.concat(F.col("charges").cast("string"), F.lit(" charges within a day, together "), _usd(F.col("amount_cents")))
    return _alert(found, "rapid_fire", said, keys)


def rapid_fire_rows(rows: DataFrame, bursts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The charges behind each rapid-fire alert."""
    days = bursts.select(*keys, "merchant_norm", F.col("posted_at").alias("burst_at"), F.explode(F.array(
        F.col("posted_at"), F.date_add("posted_at", 1))).alias("posted_at"))
    return rows.filter("amount_cents < 0").join(days, [*keys, "merchant_norm", "posted_at"])


def refund_recharges(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """For each refund the first similar charge of the merchant in the week after it.

    Alike refunds and alike charges are one lot; an alert stands for each refund.
    A charge of the refund's own day counts when it is listed after it, here: always.
    """
    lot = [*keys, "merchant_norm", "posted_at", "amount_cents"]
    lots = rows.groupBy(*lot).agg(F.count("*").alias("n"), F.min_by(
        F.struct("account_name", "raw_description"), "fingerprint").alias("shown"))
    cents = F.abs("amount_cents").cast("double")
    low, high = F.floor(F.ln(cents * (1 - RECHARGE_SHARE)) / CENT_BAND), F.floor(F.ln(cents * (1 + RECHARGE_SHARE)) / CENT_BAND)
    refunds = lots.filter("amount_cents > 0").select(
        *keys, "merchant_norm", F.col("posted_at").alias("refund_at"), F.col("amount_cents").alias("refund_cents"), "n",
        F.explode(F.sequence(low, high)).alias("band"),
    ).withColumn("week", F.explode(F.array_distinct(F.array(
        F.floor(day_number(F.col("refund_at")) / (RECHARGE_DAYS + 1)),
        F.floor((day_number(F.col("refund_at")) + RECHARGE_DAYS) / (RECHARGE_DAYS + 1))))))
    charges = lots.filter("amount_cents < 0").select(
        *keys, "merchant_norm", "posted_at", F.abs("amount_cents").alias("amount_cents"), "shown",
        F.floor(F.ln(cents) / CENT_BAND).alias("band"),
        F.floor(day_number(F.col("posted_at")) / (RECHARGE_DAYS + 1)).alias("week"))
    found = (
        refunds.join(charges, [*keys, "merchant_norm", "band", "week"])
        .filter(F.datediff("posted_at", "refund_at").between(0, RECHARGE_DAYS)
                & (F.abs(F.col("amount_cents") - F.col("refund_cents")) <= F.col("refund_cents") * RECHARGE_SHARE))
        .groupBy(*keys, "merchant_norm", "refund_at", "refund_cents", "n")
        .agg(F.min(F.struct("posted_at", "amount_cents", "shown")).alias("c"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
        .select(*keys, "merchant_norm", "refund_at", "refund_cents", "c.posted_at", "c.amount_cents", "c.shown.*")
    )
    said = F.concat(F.lit("Refund "), _usd(F.col("refund_cents")), F.lit(" on "), F.col("refund_at").cast("string"),
                    F.lit(", then charge "), _usd(F.col("amount_cents")), F.lit(" on "), F.col("posted_at").cast("string"))
    return _alert(found, "refund_recharge", said, keys, "refund_at")


def suppress(alerts: DataFrame, merchant_rules: DataFrame | None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Drops alerts of trusted merchants, and of patterns trusted for a merchant."""
    if merchant_rules is None:
        return alerts
    merchant = merchant_rules.select(*keys, F.col("merchant_pattern").alias("merchant_norm"), "rule_type")
    trusted = merchant.filter("rule_type = 'trust'").drop("rule_type")
    by_pattern = merchant.filter(F.startswith("rule_type", F.lit("trust_"))).select(
        *keys, "merchant_norm", F.regexp_replace("rule_type", "trust_", "").alias("pattern_type"))
    return alerts.join(trusted, [*keys, "merchant_norm"], "left_anti").join(
        by_pattern, [*keys, "merchant_norm", "pattern_type"], "left_anti")


def with_alert_key(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("alert_key", text.alert_key(
        F.col("pattern_type"), F.col("merchant_norm"), F.col("amount_cents"), F.col("posted_at")))


def unhandled(alerts: DataFrame, actions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Alerts the user has not acted on yet."""
    return with_alert_key(alerts).join(actions.select(*keys, "alert_key"), [*keys, "alert_key"], "left_anti")


def learned_rules(actions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Trust rules from dismissals: a pattern dismissed again for a merchant is trusted there."""
    return (
        actions.filter("action = 'not_suspicious'").groupBy(*keys, "merchant_norm", "pattern_type")
        .agg(F.count("*").alias("dismissals")).filter("dismissals >= 2")
        .select(*keys, F.col("merchant_norm").alias("merchant_pattern"),
                F.concat(F.lit("trust_"), "pattern_type").alias("rule_type"), "dismissals")
    )


def severity_rank(severity: Column) -> Column:
    chain = F
    for name, rank in SEVERITY_RANK.items():
        chain = chain.when(severity == name, F.lit(rank))
    return chain.otherwise(F.lit(99))


def alert_feed(
    rows: DataFrame, patterns: DataFrame, merchant_rules: DataFrame | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """All charge alerts after suppression, with the rank that orders them."""
    feed = duplicate_charges(rows, keys)
    for more in (unusual_amounts(rows, patterns, keys), test_charges(rows, keys), round_first_charges(rows, patterns, keys),
                 rapid_fire(rows, keys), refund_recharges(rows, keys)):
        feed = feed.unionByName(more)
    return suppress(feed, merchant_rules, keys).withColumn("severity_rank", severity_rank(F.col("severity")))


# --- monthly alerts ------------------------------------------------------------

def monthly_alerts(
    ledger: DataFrame, patterns: DataFrame, month_start: str | dt.date, as_of: str | dt.date, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Price increases, annual renewals due, new merchants and overlapping services of a month."""
    first = dt.date.fromisoformat(str(month_start))
    end = (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    merchant = [*keys, "merchant_norm"]
    month = with_merchant_norm(ledger.filter(dates.in_range(F.col("posted_at"), first, end) & (F.col("amount_cents") < 0)))
    latest = month.filter(~is_pattern_transfer(F.col("merchant_norm"))).groupBy(*merchant).agg(
        F.max_by(F.abs("amount_cents"), F.struct("posted_at", "fingerprint")).alias("current_cents"))
    seen = latest.join(patterns, merchant, "left")
    rise = F.col("current_cents") - F.col("median_amount_cents")

    def alert(rows: DataFrame, severity: str, category: str, title: Column, detail: Column, cents: Column) -> DataFrame:
        return rows.select(*keys, F.lit(severity).alias("severity"), F.lit(category).alias("category"),
                           title.alias("title"), detail.alias("detail"), cents.alias("amount_cents"))

    risen = seen.filter(
        F.col("is_recurring") & (F.col("occurrence_count") >= 3) & (F.col("median_amount_cents") > 0)
        & ((rise > 200) | (rise / F.col("median_amount_cents") * 100 > 10)))
    price = alert(risen, "medium", "price_increase", F.concat(F.lit("Price increase: "), "merchant_norm"), F.concat(
        _usd(F.col("median_amount_cents")), F.lit(" → "), _usd(F.col("current_cents")), F.lit(" (+"),
        F.format_string("%.0f", rise / F.col("median_amount_cents") * 100), F.lit("%)")), rise)

    days_until = F.datediff(F.date_add("last_seen", F.col("median_interval_days")), dates.as_date(as_of))
    due = patterns.filter(F.col("is_recurring") & (F.col("cadence") == "annual") & days_until.between(1, 30))
    renewal = alert(due, "medium", "renewal", F.concat(F.lit("Annual renewal soon: "), "merchant_norm"), F.concat(
        F.lit("~"), _usd(F.col("median_amount_cents")), F.lit(" expected in "), days_until.cast("string"), F.lit(" days")),
        F.col("median_amount_cents"))

    fresh = seen.filter((F.col("occurrence_count").isNull()
                         | ((F.col("occurrence_count") == 1) & (F.col("first_seen") >= dates.as_date(first))))
                        & (F.col("current_cents") >= 2000))
    new = alert(fresh, "low", "new_merchant", F.concat(F.lit("New merchant: "), "merchant_norm"), F.concat(
        _usd(F.col("current_cents")), F.lit(" - verify this is legitimate")), F.col("current_cents"))

    families = latest.withColumn("family", first_family(F.col("merchant_norm"), kw.ALERT_FAMILIES)).filter("family is not null")
    by_name = Window.partitionBy(*keys, "family").orderBy("merchant_norm")
    overlap = families.groupBy(*keys, "family").agg(F.count("*").alias("services"), F.sum("current_cents").alias("cents"))
    names = families.withColumn("place", F.row_number().over(by_name)).filter("place <= 3").groupBy(*keys, "family").agg(
        F.array_join(F.sort_array(F.collect_list("merchant_norm")), ", ").alias("names"))
    bundle = alert(
        overlap.filter("services >= 2").join(names, [*keys, "family"]), "medium", "bundle",
        F.concat(F.lit("Possible duplicate: "), F.initcap(F.replace("family", F.lit("_"), F.lit(" ")))),
        F.concat(F.col("services").cast("string"), F.lit(" services: "), "names"), F.col("cents"))
    return price.unionByName(renewal).unionByName(new).unionByName(bundle).withColumn(
        "severity_rank", severity_rank(F.col("severity")))


# --- report anomalies by raw label ---------------------------------------------

def _labelled(ledger: DataFrame, as_of: str | dt.date, days: int) -> DataFrame:
    return look_back(ledger, as_of, days).withColumn(
        "label", text.raw_label(F.col("merchant"), F.col("description"))).filter("label is not null")


def amount_spikes(ledger: DataFrame, as_of: str | dt.date, days: int = 120, keys: Sequence[str] = KEYS) -> DataFrame:
    """Labels with six or more rows whose newest amount is over 2.5 times the median of the rest, and over $100."""
    group = [*keys, "label"]
    rows = _labelled(ledger, as_of, days)
    newest = rows.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.max(F.struct("posted_at", "fingerprint", "amount_cents")).alias("last"),
    ).filter("n >= 6")
    counted = rows.groupBy(*group, F.abs("amount_cents").alias("cents")).agg(F.count("*").alias("n"))
    last = newest.select(*group, F.abs("last.amount_cents").alias("last_cents"))
    rest = counted.join(last, group).withColumn(
        "n", F.col("n") - F.when(F.col("cents") == F.col("last_cents"), F.lit(1)).otherwise(F.lit(0))).filter("n > 0")
    medians = exact_median(rest, group, "cents", "n", "usual")
    limit = F.greatest(F.floor(F.col("usual") * 2.5), F.lit(10000))
    return (
        newest.join(medians, group).filter((F.col("usual") != 0) & (F.abs("last.amount_cents") > limit))
        .select(*group, F.col("last.posted_at").alias("posted_at"), F.col("last.amount_cents").alias("amount_cents"),
                F.col("usual").cast("bigint").alias("baseline_cents"))
    )


def exact_repeats(ledger: DataFrame, as_of: str | dt.date, days: int = 120, keys: Sequence[str] = KEYS) -> DataFrame:
    """Label, day and amount seen more than once."""
    return _labelled(ledger, as_of, days).groupBy(*keys, "label", "posted_at", "amount_cents").agg(
        F.count("*").alias("copies")).filter("copies > 1")


def new_labels(ledger: DataFrame, as_of: str | dt.date, days: int = 120, keys: Sequence[str] = KEYS) -> DataFrame:
    """Labels of the last 14 days that the 90 days before do not have."""
    today = dates.as_date(as_of)
    recent_from, prior_from = F.date_sub(today, 14), F.date_sub(today, 104)
    ages = _labelled(ledger, as_of, days).groupBy(*keys, "label").agg(
        F.bool_or(F.col("posted_at") >= recent_from).alias("recent"),
        F.bool_or((F.col("posted_at") >= prior_from) & (F.col("posted_at") < recent_from)).alias("prior"))
    return ages.filter("recent and not prior").select(*keys, "label")


def largest_rows(
    ledger: DataFrame, as_of: str | dt.date, days: int = 60, limit: int = 50, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The largest rows of each ledger by absolute amount."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.abs("amount_cents")), "posted_at", "fingerprint")
    rows = with_merchant_norm(look_back(ledger, as_of, days))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select(
        *keys, "place", "posted_at", "merchant_norm", "amount_cents", "fingerprint")


# --- the same charge on two accounts ---------------------------------------------

def cross_account_duplicates(
    ledger: DataFrame,
    accounts_dim: DataFrame,
    as_of: str | dt.date,
    days: int = 60,
    accounts: Sequence[str] | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Equal amounts on different accounts within two days with similar merchants, one row per pair of account days."""
    several = accounts if accounts and len(accounts) > 1 else None
    lot = [*keys, "amount_cents", "account_id", "posted_at", "merchant_norm"]
    lots = with_merchant_norm(for_accounts_or_all(look_back(ledger, as_of, days), several)).select(*lot).distinct()

    def side(n: int, day: str) -> DataFrame:
        return lots.select(*keys, "amount_cents", F.col("account_id").alias(f"account_{n}"),
                           F.col("posted_at").alias(f"date_{n}"), F.col("merchant_norm").alias(f"merchant_{n}"),
                           F.col("posted_at").alias(day))

    first = side(1, "day").withColumn("day", F.explode(F.array(*[F.date_add("day", n) for n in range(3)])))
    pairs = first.join(side(2, "day"), [*keys, "amount_cents", "day"]).filter(
        (F.col("account_1") != F.col("account_2"))
        & ((F.col("date_1") < F.col("date_2")) | (F.col("account_1") < F.col("account_2"))))
    similarity = text.merchant_similarity(F.col("merchant_1"), F.col("merchant_2"))
    best = (
        pairs.withColumn("similarity", similarity).filter("similarity >= 0.3")
        .groupBy(*keys, "amount_cents", "account_1", "date_1", "account_2", "date_2")
        .agg(F.min(F.struct("merchant_1", "merchant_2", "similarity")).alias("m"))
        .select("*", "m.*").drop("m")
    )
    for n in (1, 2):
        names = accounts_dim.select(F.col("account_id").alias(f"account_{n}"), F.col("name").alias(f"account_{n}_name"))
        best = best.join(names, f"account_{n}", "left").withColumn(
            f"account_{n}_name", F.coalesce(f"account_{n}_name", F.lit("Unknown")))
    return best
