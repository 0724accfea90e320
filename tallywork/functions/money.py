"""Column functions over money. Amounts are whole cents in bigint columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sanity bound in dollars, cadence multipliers per month.
SANITY_DOLLARS = 1_000_000
COMMITMENT_MULTIPLIERS = {"monthly": 1.0, "weekly": 4.33, "biweekly": 2.17, "quarterly": 1 / 3, "annual": 1 / 12}


def dollars_to_cents(dollars: Column) -> Column:
    """Half-up cents of a decimal column."""
    return F.round(dollars.cast("decimal(28,8)") * F.lit(100), 0).cast("bigint")


def parse_cents(text: Column, allow_large: bool = False) -> Column:
    """Cents of a money text with optional thousands commas.

    Null when the text is no number, or is beyond the sanity bound.
    """
    dollars = F.regexp_replace(F.trim(text.cast("string")), ",", "").try_cast("decimal(28,8)")
    cents = dollars_to_cents(dollars)
    return cents if allow_large else F.when(F.abs(dollars) <= SANITY_DOLLARS, cents)


def parse_statement_cents(text: Column) -> Column:
    """Cents of a bank-file money text: dollar signs, commas, blanks, (x) for minus; empty is 0."""
    bare = F.regexp_replace(F.trim(F.coalesce(text, F.lit("0"))), r"[$, ]", "")
    signed = F.regexp_replace(bare, r"^\((.*)\)$", "-$1")
    return F.when(signed == "", F.lit(0).cast("bigint")).otherwise(dollars_to_cents(signed.try_cast("decimal(28,8)")))


def cents_to_dollars(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") / F.lit(100)).cast("decimal(18,2)")


def format_usd(cents: Column, show_sign: bool = False) -> Column:
    body = F.concat(F.lit("$"), F.format_number(cents_to_dollars(F.abs(cents)), 2))
    plus = F.when(cents > 0, F.concat(F.lit("+"), body)) if show_sign else F.when(F.lit(False), body)
    return F.when(cents < 0, F.concat(F.lit("-"), body)).otherwise(F.coalesce(plus, body))


def format_usd_compact(cents: Column) -> Column:
    """Like format_usd, without the decimals when the amount is whole dollars."""
    whole = F.concat(F.lit("$"), F.format_number(cents_to_dollars(F.abs(cents)), 0))
    return F.when(
        F.abs(cents) % 100 == 0, F.when(cents < 0, F.concat(F.lit("-"), whole)).otherwise(whole)
    ).otherwise(format_usd(cents))


def plain_usd(cents: Column) -> Column:
    """Dollars as plain text with two decimals, for export files."""
    return cents_to_dollars(cents).cast("string")


def _exact(value: Column | float | str) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("decimal(18,9)")


def multiply_cents(cents: Column, factor: Column | float | str) -> Column:
    return F.round(cents.cast("decimal(19,0)") * _exact(factor), 0).cast("bigint")


def divide_cents(cents: Column, divisor: Column | float | str) -> Column:
    """Half-up quotient, null for a zero divisor."""
    return F.round(F.try_divide(cents.cast("decimal(19,0)"), _exact(divisor)), 0).cast("bigint")


def percent_of(cents: Column, percent: Column | float | str) -> Column:
    return F.round(cents.cast("decimal(19,0)") * _exact(percent) / F.lit(100), 0).cast("bigint")


def within_threshold(a: Column, b: Column, cents: int = 0, percent: float = 0.0) -> Column:
    """Close by an absolute or a relative margin; with no margin, equal."""
    if cents == 0 and percent == 0:
        return a == b
    diff = F.abs(a - b)
    base = F.greatest(F.abs(a), F.abs(b), F.lit(1))
    near = F.lit(False)
    if cents > 0:
        near = near | (diff <= cents)
    if percent > 0:
        near = near | (diff / base * 100 <= percent)
    return near


def floor_div(a: Column, n: int | Column) -> Column:
    """Quotient rounded down, also for negative numbers."""
    return F.floor(a / n).cast("bigint")


def monthly_equivalent(cents: Column, cadence: Column) -> Column:
    """Cost per month of a charge seen at a detected cadence."""
    return (
        F.when(cadence == "annual", floor_div(cents, 12))
        .when(cadence == "quarterly", floor_div(cents, 3))
        .when(cadence == "bimonthly", floor_div(cents, 2))
        .when(cadence == "weekly", F.bround(cents * 52 / F.lit(12)).cast("bigint"))
        .when(cadence == "biweekly", F.bround(cents * 26 / F.lit(12)).cast("bigint"))
        .otherwise(cents)
    )


def bundle_monthly_equivalent(cents: Column, cadence: Column) -> Column:
    """Bundle groups scale annual and quarterly charges only."""
    return (
        F.when(cadence == "annual", floor_div(cents, 12))
        .when(cadence == "quarterly", floor_div(cents, 3))
        .otherwise(cents)
    )


def commitment_monthly_equivalent(cents: Column, cadence: Column) -> Column:
    """Cost per month of a confirmed commitment; one-time items and unknown amounts count 0."""
    factor = F.lit(1.0)
    for name, value in COMMITMENT_MULTIPLIERS.items():
        factor = F.when(cadence == name, F.lit(value)).otherwise(factor)
    return F.when((cadence == "one_time") | cents.isNull(), F.lit(0).cast("bigint")).otherwise(
        (cents * factor).cast("bigint")
    )
