"""Column functions over merchant and description text."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def merchant_norm(merchant: Column, description: Column) -> Column:
    """The grouping key of the whole library: first non-empty text, lower case, trimmed."""
    return F.trim(F.lower(F.coalesce(F.nullif(merchant, F.lit("")), F.nullif(description, F.lit("")), F.lit(""))))


def raw_label(merchant: Column, description: Column) -> Column:
    """First non-empty text as written, null when both are empty."""
    return F.coalesce(F.nullif(merchant, F.lit("")), F.nullif(description, F.lit("")))


def raw_description(merchant: Column, description: Column) -> Column:
    return F.coalesce(description, merchant, F.lit(""))


def contains_any(col: Column, words: Iterable[str]) -> Column:
    """True when any of the words is a substring."""
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(w)) for w in words])


def any_word(col: Column, words: Iterable[str]) -> Column:
    """True when any of the words occurs as a whole word."""
    return col.rlike(r"\b(?:" + "|".join(words) + r")\b")


def first_match(col: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Value of the first (word, value) pair whose word is a substring, else null."""
    chain = None
    for word, value in pairs:
        hit = F.contains(col, F.lit(word))
        chain = F.when(hit, F.lit(value)) if chain is None else chain.when(hit, F.lit(value))
    return chain


def norm_text(col: Column) -> Column:
    """Upper case with runs of white space made one blank; null becomes empty."""
    return F.upper(F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " ")))


def fuzzy_key(col: Column) -> Column:
    """Merchant name without processor tail, company suffix and trailing id number."""
    head = F.element_at(F.split(F.trim(F.lower(col)), r"\*", 2), 1)
    no_suffix = F.regexp_replace(head, r"\s*(\.com|\.net|\.org|inc\.?|llc\.?|ltd\.?|corp\.?|\*+)$", "")
    no_id = F.regexp_replace(no_suffix, r"\s+\d{4,}$", "")
    return F.trim(F.regexp_replace(no_id, r"\s+", " "))


def significant_word(col: Column) -> Column:
    """First word longer than two letters, null when there is none."""
    words = F.filter(F.split(col, r"[\s._-]+"), lambda w: F.length(w) > 2)
    return F.get(words, F.lit(0))


def merchants_match(a: Column, b: Column) -> Column:
    """Equal, one inside the other, or the same first significant word."""
    same_word = F.coalesce(significant_word(a) == significant_word(b), F.lit(False))
    return (a != "") & (b != "") & ((a == b) | F.contains(a, b) | F.contains(b, a) | same_word)


def merchant_similarity(a: Column, b: Column) -> Column:
    """Similarity 0 to 1 from equality, containment, shared words, shared prefix."""
    words_a = F.array_distinct(F.split(F.trim(a), r"\s+"))
    words_b = F.array_distinct(F.split(F.trim(b), r"\s+"))
    shared = F.size(F.array_intersect(words_a, words_b))
    union = F.size(F.array_union(words_a, words_b))
    first_a, first_b = F.get(words_a, F.lit(0)), F.get(words_b, F.lit(0))
    prefix = (
        (F.length(first_a) > 3)
        & (F.length(first_b) > 3)
        & (F.startswith(first_a, F.substring(first_b, 1, 4)) | F.startswith(first_b, F.substring(first_a, 1, 4)))
    )
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when(F.contains(a, b) | F.contains(b, a), F.lit(0.9))
        .when(shared > 0, F.lit(0.5) + F.lit(0.4) * (shared / union))
        .when(prefix, F.lit(0.5))
        .otherwise(F.lit(0.0))
    )


def alert_key(pattern: Column, merchant: Column, cents: Column, day: Column) -> Column:
    return F.concat_ws("|", pattern, merchant, cents.cast("string"), day.cast("string"))


def split_alert_key(key: Column) -> Column:
    """Struct (pattern_type, merchant_norm, amount_cents, posted_at) of an alert key.

    The merchant may itself hold the separator, so the ends are cut first.
    """
    parts = F.split(key, r"\|")
    n = F.size(parts)
    return F.struct(
        F.get(parts, F.lit(0)).alias("pattern_type"),
        F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 3, F.lit(0))), "|").alias("merchant_norm"),
        F.get(parts, n - 2).try_cast("bigint").alias("amount_cents"),
        F.get(parts, n - 1).try_cast("date").alias("posted_at"),
    )


def csv_safe(col: Column) -> Column:
    """Text safe for a spreadsheet: null is empty, a formula start gets an apostrophe."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
