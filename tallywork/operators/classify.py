"""Row classification: one of five types, a spending bucket, a category."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..lexicon import categories, keywords as kw
from ..lexicon.services import known_services
from ..session import store
from .containment import containing
from .scan import KEYS

INCOME, EXPENSE, TRANSFER, REFUND, CREDIT_OTHER = "INCOME", "EXPENSE", "TRANSFER", "REFUND", "CREDIT_OTHER"
FIXED, VARIABLE, DISCRETIONARY, ONE_OFFS = (
    "FIXED_OBLIGATIONS", "VARIABLE_ESSENTIALS", "DISCRETIONARY", "ONE_OFFS",
)


# --- accounts ---------------------------------------------------------------

def is_card_type(account_type: Column) -> Column:
    """Credit card by the account's type."""
    return F.contains(F.lower(F.coalesce(account_type, F.lit(""))), F.lit("credit"))


def is_card_name(name: Column) -> Column:
    """Credit card by the account's name."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return ~text.contains_any(low, kw.NOT_CARD_NAME) & text.contains_any(low, kw.CARD_NAME)


def with_card_flag(ledger: DataFrame, accounts_dim: DataFrame, where: Column | None = None) -> DataFrame:
    """Adds is_card. With `where`, accounts are looked up for the rows it holds for; the others have a null flag and are not shuffled."""
    cards = accounts_dim.filter(is_card_type(F.col("type"))).select("account_id", F.lit(True).alias("is_card"))
    chosen = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    looked_up = ledger.filter(chosen).join(cards.distinct(), "account_id", "left").withColumn("is_card", F.coalesce("is_card", F.lit(False)))
    if where is None:
        return looked_up
    return looked_up.unionByName(ledger.filter(~chosen).withColumn("is_card", F.lit(None).cast("boolean")))


def reads_card_flag() -> Column:
    """Rows whose type can hang on is_card: money in, and wording of a card payment."""
    return (F.col("amount_cents") > 0) | text.contains_any(F.col("merchant_norm"), kw.CARD_PAYMENT)


def expense_only_view(accounts_dim: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Ledgers whose selected accounts are all credit cards."""
    card = is_card_type(F.col("type")) | is_card_name(F.col("name"))
    return accounts_dim.groupBy(*keys).agg(F.bool_and(card).alias("expense_only"))


# --- user rules -------------------------------------------------------------

def _pattern_hits(merchants: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, merchant_norm) with every rule of the same ledger it contains."""
    rules = rules.withColumn("lower_pattern", F.lower("merchant_pattern"))
    hits = containing(merchants, rules, "merchant_norm", "lower_pattern", keys)
    return hits.join(rules, [*keys, "lower_pattern"])


def with_overrides(
    rows: DataFrame,
    type_overrides: DataFrame | None,
    merchant_rules: DataFrame | None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Adds override_type, income_hint (INCOME / NOT_INCOME) and hint_pattern.

    An exact fingerprint beats the first matching merchant pattern; either beats
    a hint, and an income hint beats a not-income hint. Patterns are tested on
    distinct merchants of the same ledger only.
    """
    none = F.lit(None).cast("string")
    ruled = type_overrides is not None or merchant_rules is not None
    merchants = store(rows.select(*keys, "merchant_norm").distinct()) if ruled else None
    if type_overrides is not None:
        exact = type_overrides.filter("fingerprint is not null").groupBy(*keys, "fingerprint").agg(
            F.max_by("target_type", "rule_order").alias("exact_type")
        )
        patterns = _pattern_hits(merchants, type_overrides.filter(
            "fingerprint is null and merchant_pattern is not null and merchant_pattern <> ''"), keys)
        first = patterns.groupBy(*keys, "merchant_norm").agg(F.min_by("target_type", "rule_order").alias("pattern_type"))
        rows = rows.join(exact, [*keys, "fingerprint"], "left").join(first, [*keys, "merchant_norm"], "left")
        rows = rows.withColumn("override_type", F.coalesce("exact_type", "pattern_type")).drop("exact_type", "pattern_type")
    else:
        rows = rows.withColumn("override_type", none)
    if merchant_rules is not None:
        hints = merchant_rules.filter(F.col("rule_type").isin("income", "not_income"))
        best = _pattern_hits(merchants, hints, keys).groupBy(*keys, "merchant_norm").agg(
            F.min(F.struct("rule_type", F.lower("merchant_pattern").alias("pattern"))).alias("hint")
        )
        rows = rows.join(best, [*keys, "merchant_norm"], "left")
        rows = rows.withColumn(
            "income_hint", F.when(F.col("override_type").isNull(), F.upper("hint.rule_type"))
        ).withColumn("hint_pattern", F.col("hint.pattern")).drop("hint")
    else:
        rows = rows.withColumn("income_hint", none).withColumn("hint_pattern", none)
    return rows


# --- the canonical type -----------------------------------------------------

def bank_to_bank(m: Column) -> Column:
    return text.contains_any(m, kw.BANK) & text.contains_any(m, kw.BANK_DIRECTION)


def _decide(rules: list[tuple[Column, str, str, float, Column]]) -> Column:
    """Struct (type, code, confidence, evidence) of the first rule that holds."""
    chain = F
    for condition, kind, code, confidence, evidence in rules:
        chain = chain.when(
            condition,
            F.struct(
                F.lit(kind).alias("type") if isinstance(kind, str) else kind.alias("type"),
                F.lit(code).alias("code"),
                F.lit(confidence).alias("confidence"),
                F.array(evidence).alias("evidence"),
            ),
        )
    return chain


def classify(rows: DataFrame) -> DataFrame:
    """Adds txn_type, reason_code, confidence, evidence, matched_fingerprint, spending_bucket.

    Reads amount_cents, merchant_norm, is_card, override_type, income_hint,
    hint_pattern, is_paired, refund_of and the pattern flags pattern_transfer,
    pattern_subscription, pattern_habitual; absent ones count as unset.
    """
    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if name in rows.columns else F.lit(False)

    def value(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    m, amount = F.col("merchant_norm"), F.col("amount_cents")
    credit = amount > 0
    refund_of, override, hint = value("refund_of"), value("override_type"), value("income_hint")
    transfer_word = text.contains_any(m, kw.TRANSFER)

    def say(words: str, *tail: Column) -> Column:
        return F.concat(F.lit(words), *tail) if tail else F.lit(words)

    rules = [
        (override.isNotNull(), override, "USER_OVERRIDE", 1.0, say("set by the user: ", override)),
        (flag("is_paired"), TRANSFER, "TRANSFER_PAIR_MATCHED", 1.0, say("both legs of a transfer were found")),
        (refund_of.isNotNull() & credit, REFUND, "REFUND_MATCHED", 1.0,
         say("gives back the charge ", F.substring(refund_of, 1, 8))),
        (credit & (hint == "NOT_INCOME"), CREDIT_OTHER, "USER_NOT_INCOME_RULE", 1.0,
         say("the user rules out income from: ", value("hint_pattern"))),
        (credit & (hint == "INCOME"), INCOME, "USER_INCOME_RULE", 1.0,
         say("the user counts as income: ", value("hint_pattern"))),
        (~credit & ~flag("is_card") & text.contains_any(m, kw.CARD_PAYMENT), TRANSFER, "TRANSFER_CC_PAYMENT", 0.95,
         say("pays a card bill")),
        (flag("pattern_transfer"), TRANSFER, "TRANSFER_BANK_PATTERN", 0.9, say("the merchant's pattern is a transfer")),
        (transfer_word, TRANSFER, "TRANSFER_BANK_PATTERN", 0.8, say("transfer wording: ", m)),
        (credit & bank_to_bank(m), TRANSFER, "TRANSFER_BANK_PATTERN", 0.85, say("moves between banks")),
        (credit & flag("is_card"), TRANSFER, "TRANSFER_CC_PAYMENT", 0.95,
         say("money in on a card account")),
        (credit & text.contains_any(m, kw.REFUND), REFUND, "REFUND_KEYWORD", 0.7, say("refund wording: ", m)),
        (credit & text.contains_any(m, kw.PAYROLL), INCOME, "INCOME_PAYROLL", 0.9, say("payroll wording: ", m)),
        (credit, CREDIT_OTHER, "CREDIT_UNCLASSIFIED", 0.5, say("money in of unknown kind, to be reviewed")),
        (F.lit(True), EXPENSE, "EXPENSE_DEFAULT", 0.8, say("money out, nothing else applies")),
    ]
    reason = F.col("reason")
    return (
        rows.withColumn("reason", _decide(rules))
        .withColumns({
            "txn_type": reason["type"],
            "reason_code": reason["code"],
            "confidence": reason["confidence"],
            "evidence": reason["evidence"],
            "matched_fingerprint": F.when(reason["code"] == "REFUND_MATCHED", refund_of),
            "spending_bucket": F.when(
                reason["code"] == "EXPENSE_DEFAULT",
                F.when(flag("pattern_subscription"), F.lit(FIXED))
                .when(flag("pattern_habitual"), F.lit(VARIABLE))
                .otherwise(F.lit(DISCRETIONARY)),
            ),
        })
        .drop("reason")
    )


# --- the five-label classifier ----------------------------------------------

def is_pattern_transfer(m: Column) -> Column:
    return text.contains_any(m, kw.PATTERN_TRANSFER)


def transfer_like(m: Column) -> Column:
    """Transfer wording on either side, for first-fit pairing."""
    return is_pattern_transfer(m) | text.contains_any(m, kw.CREDIT_TRANSFER)


def five_label(rows: DataFrame) -> DataFrame:
    """Adds label: income, credit, recurring, transfer or one-off.

    Same optional inputs as classify, plus pattern_recurring.
    """
    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if name in rows.columns else F.lit(False)

    m, credit = F.col("merchant_norm"), F.col("amount_cents") > 0
    hint = F.col("income_hint") if "income_hint" in rows.columns else F.lit(None).cast("string")
    label = (
        F.when(flag("is_paired"), F.lit("transfer"))
        .when(credit & (hint == "NOT_INCOME"), F.lit("credit"))
        .when(credit & (hint == "INCOME"), F.lit("income"))
        .when(flag("pattern_transfer"), F.lit("transfer"))
        .when(credit & text.contains_any(m, kw.CREDIT_TRANSFER), F.lit("transfer"))
        .when(credit & text.contains_any(m, kw.STRONG_INCOME), F.lit("income"))
        .when(credit, F.lit("credit"))
        .when(~flag("is_card") & text.contains_any(m, kw.CARD_PAYMENT_OUT), F.lit("transfer"))
        .when(is_pattern_transfer(m), F.lit("transfer"))
        .when(flag("pattern_recurring"), F.lit("recurring"))
        .otherwise(F.lit("one-off"))
    )
    return rows.withColumn("label", label)


# --- categories -------------------------------------------------------------

def ordered_category_rules() -> list[tuple[str, str, float]]:
    """Rules from the most to the least confident, rule order on a tie."""
    return sorted(categories.CATEGORY_RULES, key=lambda r: -r[2])


def category_rule(merchant: Column, description: Column) -> Column:
    """Place in ordered_category_rules of the first rule that hits the text; null when none does."""
    words = F.lower(F.concat_ws(" ", merchant, F.coalesce(description, F.lit(""))))
    chain = F
    for place, (pattern, _, _) in enumerate(ordered_category_rules()):
        unicode = "(?U)" if "\\w" in pattern or "\\b" in pattern else ""
        chain = chain.when(words.rlike(unicode + pattern), F.lit(place))
    return chain


def category_of(merchant: Column, description: Column) -> Column:
    """Category by rule, other when none hits."""
    names = F.split(F.lit(",".join(name for _, name, _ in ordered_category_rules())), ",")
    return F.coalesce(F.get(names, category_rule(merchant, description)), F.lit("other"))


def category_confidence(merchant: Column, description: Column) -> Column:
    values = F.split(F.lit(",".join(str(sure) for _, _, sure in ordered_category_rules())), ",")
    return F.coalesce(F.get(values, category_rule(merchant, description)).cast("double"), F.lit(0.0))


def with_rule_category(rows: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """Adds the category by rule of each row's merchant_norm and description, judged once for each different text of `texts`.

    The texts are stored, so their size is known: the planner broadcasts them while they are few."""
    text_of = ["merchant_norm", "description"]
    judged = store(texts.select(*text_of).distinct().withColumn(name, category_of(F.col("merchant_norm"), F.col("description"))))
    return rows.join(judged, text_of, "left")


def category_texts(ledger: DataFrame) -> DataFrame:
    """Each distinct text of the ledger once, with its category.

    Texts repeat far more than they are new, so the rules run on this table, not
    on rows. Stored, its size is known: the planner broadcasts it while it is
    small and joins it by shuffle when it is not.
    """
    rows = ledger.select(
        text.merchant_norm(F.col("merchant"), F.col("description")).alias("merchant_norm"),
        text.raw_description(F.col("merchant"), F.col("description")).alias("described"),
    ).distinct()
    return rows.withColumn("rule_category", category_of(F.col("merchant_norm"), F.col("described")))


def with_category(
    rows: DataFrame, category_overrides: DataFrame | None = None, texts: DataFrame | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Adds category_id to EXPENSE and REFUND rows; a user's override beats the rules.

    With `texts` (see category_texts) the rules are looked up, without they run per row.
    """
    described = text.raw_description(F.col("merchant"), F.col("description"))
    if texts is None:
        rows = rows.withColumn("rule_category", category_of(F.col("merchant_norm"), described))
    else:
        rows = rows.withColumn("described", described).join(texts, ["merchant_norm", "described"], "left").drop("described")
    chosen = F.col("rule_category")
    if category_overrides is not None:
        users = category_overrides.select(*keys, "merchant_norm", F.col("category_id").alias("user_category"))
        rows = rows.join(users, [*keys, "merchant_norm"], "left")
        chosen = F.coalesce("user_category", "rule_category")
    spent = F.col("txn_type").isin(EXPENSE, REFUND)
    return rows.withColumn("category_id", F.when(spent, chosen)).drop("rule_category", "user_category")


def signed_category(amount: Column, found: Column, override: Column | None = None) -> Column:
    """Category of a row by its sign: a credit keeps a spending category, else is income or a one-time deposit.

    `found` is the category by rule; a rule that hits is always sure enough.
    """
    kept = found.isin(categories.REFUNDABLE) | (found == "income")
    by_rule = F.when((amount <= 0) | kept, found).otherwise(F.lit("one_time_deposit"))
    if override is None:
        return by_rule
    return F.when(override.isin(categories.CATEGORIES), override).otherwise(by_rule)


# --- services, families, noise ----------------------------------------------

def service_registry(spark: SparkSession) -> DataFrame:
    """pattern, display_name, service_cadence and place (longest pattern first) of the known services."""
    rows = [(p, n, c, k) for k, (p, n, c) in enumerate(known_services())]
    return spark.createDataFrame(rows, "pattern string, display_name string, service_cadence string, place int")


def with_service(rows: DataFrame, merchant: str = "merchant_norm", registry: DataFrame | None = None) -> DataFrame:
    """Adds service: struct (display_name, service_cadence) of the first pattern in `place` order that the merchant contains, or null.

    Patterns are looked up once for each different merchant."""
    registry = service_registry(rows.sparkSession) if registry is None else registry
    hits = containing(rows.select(F.col(merchant).alias("text_of")), registry, "text_of", "pattern").join(registry, "pattern")
    best = hits.groupBy("text_of").agg(F.min_by(F.struct("display_name", "service_cadence"), "place").alias("service"))
    return rows.join(best, rows[merchant] == best["text_of"], "left").drop("text_of")


def known_service(m: Column) -> Column:
    """The same as an expression over the built-in registry, for a column of few texts; tables go through with_service."""
    return F.coalesce(*[F.when(F.contains(m, F.lit(p)), F.struct(F.lit(n).alias("display_name"), F.lit(c).alias("service_cadence")))
                        for p, n, c in known_services()])


def is_noise(m: Column) -> Column:
    return text.contains_any(m, kw.NOISE)


def vendor_family(label: Column) -> Column:
    """Struct (family, subtype) of the vendors that sell several services."""
    s = F.lower(F.coalesce(label, F.lit("")))

    def has(*words: str) -> Column:
        return reduce(lambda a, b: a & b, [F.contains(s, F.lit(w)) for w in words])

    def pick(family: str, *subtypes: tuple[Column | None, str]) -> Column:
        chain = F
        for condition, name in subtypes:
            chain = chain.otherwise(F.lit(name)) if condition is None else chain.when(condition, F.lit(name))
        return F.struct(F.lit(family).alias("family"), chain.alias("subtype"))

    return (
        F.when(has("amazon") | has("prime"), pick("amazon", (has("tip"), "tip"), (has("prime video"), "prime_video"),
                                                  (has("prime"), "prime"), (None, "amazon_misc")))
        .when(has("youtube") | has("google"), pick("google", (has("fiber"), "fiber"), (has("premium"), "youtube_premium"),
                                                   (has("member"), "youtube_membership"), (has("youtube"), "youtube_misc"),
                                                   (None, "google_misc")))
        .when(has("disney") | has("hulu") | has("espn"),
              pick("disney_bundle", (has("disney", "hulu"), "bundle"), (has("disney"), "disney"), (has("hulu"), "hulu"),
                   (None, "espn")))
        .otherwise(F.struct(F.lit("other").alias("family"), F.lit("other").alias("subtype")))
    )


def first_family(m: Column, families: dict[str, list[str]]) -> Column:
    chain = F
    for name, words in families.items():
        chain = chain.when(text.contains_any(m, words), F.lit(name))
    return chain
