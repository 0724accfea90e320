import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from tallywork.functions import dates
from tallywork.operators import classify, detectors, duplicates, merge, recurring, scan, stats
from tallywork.operators.containment import containing
from tallywork.plans import closing
from tallywork.plans import period_report as pr
from tallywork.sinks import exports
from tallywork.sources import bank_files
from tallywork.streaming import jobs

AS_OF = "2024-06-30"


def months(merchant, cents, n=6, day=5, account="card"):
    return [(account, dt.date(2024, m, day), -cents, merchant) for m in range(1, n + 1)]


@pytest.mark.parametrize("account,cents,merchant,want", [
    ("chk", 250000, "ACME Payroll", ("INCOME", "INCOME_PAYROLL")),
    ("chk", 5000, "cafe refund", ("REFUND", "REFUND_KEYWORD")),
    ("chk", 5000, "mystery", ("CREDIT_OTHER", "CREDIT_UNCLASSIFIED")),
    ("chk", 5000, "chase to you", ("TRANSFER", "TRANSFER_BANK_PATTERN")),
    ("chk", 5000, "beach bar", ("TRANSFER", "TRANSFER_BANK_PATTERN")),
    ("card", 5000, "mystery", ("TRANSFER", "TRANSFER_CC_PAYMENT")),
    ("chk", -5000, "autopay", ("TRANSFER", "TRANSFER_CC_PAYMENT")),
    ("card", -5000, "autopay", ("EXPENSE", "EXPENSE_DEFAULT")),
    ("chk", -5000, "bakery", ("EXPENSE", "EXPENSE_DEFAULT")),
])
def test_types(make_ledger, accounts, account, cents, merchant, want):
    row = pr.classified_ledger(make_ledger([(account, "2024-01-02", cents, merchant)]), accounts).first()
    assert (row.txn_type, row.reason_code) == want


def test_every_row_has_one_type_and_sums_hold(make_ledger, accounts):
    rows = [("chk", "2024-01-02", 250000, "payroll"), ("card", "2024-01-03", -2500, "kroger"), ("chk", "2024-01-04", -900, "zelle"),
            ("chk", "2024-01-05", 700, "thing"), ("card", "2024-01-09", 300, "refund x"), ("chk", "2024-01-09", 300, "refund x")]
    typed = pr.classified_ledger(make_ledger(rows), accounts)
    total = pr.period_totals(typed).first()
    net = total.income_cents + total.refunds_cents + total.credits_other_cents - total.total_expenses_cents + total.transfer_balance_cents
    assert typed.count() == 6 and net == sum(r[2] for r in rows)


def test_overrides_beat_everything(spark, make_ledger, accounts):
    ledger = make_ledger([("chk", "2024-01-02", 5000, "payroll"), ("chk", "2024-01-02", 5000, "odd income"), ("chk", "2024-01-03", 100, "gift")])
    types = spark.createDataFrame([(1, "f00000", None, "REFUND", 1), (1, None, "ODD", "TRANSFER", 2), (1, None, "odd", "EXPENSE", 3)],
                                  "owner_id long, fingerprint string, merchant_pattern string, target_type string, rule_order int")
    rules = spark.createDataFrame([(1, "gift", "income")], "owner_id long, merchant_pattern string, rule_type string")
    got = {r.fingerprint: r.txn_type for r in pr.classified_ledger(ledger, accounts, type_overrides=types, merchant_rules=rules).collect()}
    assert got == {"f00000": "REFUND", "f00001": "TRANSFER", "f00002": "INCOME"}


@pytest.mark.parametrize("text,want", [("uber eats", "dining"), ("uber trip", "transport"), ("amazon prime video", "entertainment"),
                                       ("amazon.com", "shopping"), ("city of austin water", "utilities"), ("zzz", "other"), ("netflix", "entertainment")])
def test_categories(spark, text, want):
    assert spark.range(1).select(classify.category_of(F.lit(text), F.lit(""))).first()[0] == want


def test_known_services(spark):
    rows = spark.createDataFrame([("youtube tv live",), ("youtube premium",), ("burger king",), ("apple tv",)], "m string")
    got = [r[0] for r in rows.select(classify.known_service(F.col("m"))["display_name"]).collect()]
    assert got == ["YouTube TV", "YouTube Premium", None, "Apple TV+"]


def test_median_is_exact(spark):
    values = [1, 5, 5, 9, 40000, 40001, 99999, 123456]
    for cut in range(1, len(values) + 1):
        part = values[:cut]
        df = spark.createDataFrame([("a", v) for v in part], "k string, v long").groupBy("k", "v").agg(F.count("*").alias("n"))
        median = stats.exact_median(df, ["k"], "v", "n", "m").first().m
        assert median == statistics.median(part)
        mad = stats.exact_mad(df.withColumn("m", F.lit(median)), ["k"], "v", "n", "m", "d").first().d
        assert mad == statistics.median([abs(v - median) for v in part])


def test_patterns(make_ledger):
    groceries = [("card", dt.date(2024, 3, d), -1000 * d, "grocer") for d in (1, 2, 11, 12, 28, 30)]
    got = {r.merchant_norm: r for r in recurring.merchant_patterns(make_ledger(months("Netflix", 1599) + groceries + months("Pay Late", 10, 2)), AS_OF).collect()}
    assert got["netflix"].cadence == "monthly" and got["netflix"].is_recurring and got["netflix"].amount_cv == 0
    assert got["grocer"].occurrence_count == 6 and got["grocer"].median_amount_cents == 11500
    assert got["pay late"].cadence == "" and got["pay late"].median_interval_days is None


def test_hot_merchant_has_bounded_rows(make_ledger):
    """Thousands of copies of one charge are a handful of rows after the first count."""
    rows = [("card", dt.date(2024, 6, 1 + i % 3), -500, "kiosk") for i in range(3000)]
    ledger = make_ledger(rows)
    row = recurring.merchant_patterns(ledger, AS_OF).first()
    assert row.occurrence_count == 3000 and row.median_interval_days == 0 and row.is_habitual
    assert detectors.duplicate_charges(detectors.detector_rows(ledger, ledger.select("account_id", F.lit("n").alias("name")).limit(1), AS_OF)).count() == 3


def test_detectors_on_both_sides_of_their_limits(make_ledger, accounts):
    rows = [("card", "2024-06-01", -1000, "dup"), ("card", "2024-06-04", -1000, "dup"), ("card", "2024-06-08", -1000, "dup"),
            ("card", "2024-06-01", -1, "tiny"), ("card", "2024-06-01", -100, "tiny2"), ("card", "2024-06-01", -101, "not tiny"),
            ("card", "2024-06-10", 5000, "shop"), ("card", "2024-06-17", -6000, "shop"), ("card", "2024-06-10", 5000, "shop2"),
            ("card", "2024-06-18", -5000, "shop2"), ("card", "2024-06-05", -10000, "new place"),
            ("card", "2024-06-20", -10, "fast"), ("card", "2024-06-20", -20, "fast"), ("card", "2024-06-21", -30, "fast")]
    rows += [("card", dt.date(2024, m, 2), -1500, "steady") for m in range(1, 5)] + [("card", "2024-06-02", -3000, "steady"), ("card", "2024-06-03", -3001, "steady")]
    ledger = make_ledger(rows)
    feed = detectors.alert_feed(detectors.detector_rows(ledger, accounts, AS_OF), recurring.merchant_patterns(ledger, AS_OF)).collect()
    got = sorted((a.pattern_type, a.merchant_norm, a.amount_cents) for a in feed)
    assert [g for g in got if g[0] != "test_charge"] == [
        ("duplicate_charge", "dup", 1000), ("rapid_fire", "fast", 60), ("refund_recharge", "shop", 6000),
        ("round_amount_spike", "new place", 10000), ("unusual_amount", "steady", 3001)]
    assert [g[1] for g in got if g[0] == "test_charge"] == ["fast", "fast", "fast", "tiny", "tiny2"]


def test_duplicate_groups_share_no_merchant(make_ledger):
    rows = months("NETFLIX.COM", 1599) + months("Netflix Inc", 1499, day=9) + months("HBO Max", 999, day=12) + months("Hulu", 799, day=3) + months("Disney Plus", 899, day=4)
    groups = duplicates.kept_members(duplicates.group_members(recurring.merchant_patterns(make_ledger(rows), AS_OF))).collect()
    names = [g.merchant_norm for g in groups]
    assert len(names) == len(set(names))
    assert {g.group_name for g in groups} == {"Streaming", "Disney Bundle"}


def test_bundle_pairs_are_counted(make_ledger):
    rows = months("Hulu", 799, day=3) + months("Disney Plus", 899, day=5) + months("Hulu", 799, 1, day=4)
    row = duplicates.bundle_signals(make_ledger(rows), AS_OF).first()
    assert (row.labels, row.charges, row.nearby_pairs) == (2, 13, 7)


def test_merge_is_idempotent(make_ledger):
    old = make_ledger([("chk", "2024-01-01", -100, "a"), ("chk", "2024-01-02", -200, "b")])
    batch = old.filter("fingerprint = 'f00001'").withColumn("amount_cents", F.lit(-250).cast("bigint")).withColumn("page_no", F.lit(1))
    merged = merge.merge_ledger(old, batch, "2024-02-01 00:00:00", keys=["owner_id"])
    assert sorted((r.fingerprint, r.amount_cents, r.change) for r in merged.collect()) == [("f00000", -100, "unchanged"), ("f00001", -250, "updated")]
    again = merge.merge_ledger(merged.drop("change"), batch, "2024-03-01 00:00:00", keys=["owner_id"])
    assert again.filter("change <> 'unchanged'").count() == 0


def test_bank_csv(spark, tmp_path):
    path = tmp_path / "bank.csv"
    path.write_text("Transaction Date;Amount;Description\n01/31/2024;($12.50);Cafe\n2024-02-30;1;Bad\n02/01/2024;1,000.00;\n02/02/2024;5;Shop\n")
    parsed = bank_files.parse_bank_rows(bank_files.read_bank_csv(spark, str(path), "chk"))
    good = sorted((str(r.posted_at), r.amount_cents, r.merchant) for r in bank_files.accepted(parsed).collect())
    assert good == [("2024-01-31", -1250, "Cafe"), ("2024-02-02", 500, "Shop")]
    assert sorted(r.error for r in bank_files.rejected(parsed).collect()) == ["neither description nor merchant", "no date in '2024-02-30'"]


def test_export_is_guarded(spark, tmp_path):
    out = str(tmp_path / "out")
    exports.write_csv(spark.createDataFrame([("=1", 5)], "t string, n int"), out)
    assert spark.read.option("header", True).csv(out).first().t == "'=1"


def test_reconcile_within_a_dollar(spark, make_ledger, accounts):
    ledger = make_ledger([("chk", "2024-01-01", 1000, "a"), ("chk", "2024-01-31", 500, "b"), ("chk", "2024-02-01", 7, "c"), ("chk", "2024-01-05", 9, "p")], pending={3})
    statements = spark.createDataFrame([(1, "chk", dt.date(2024, 1, 31), 1600), (1, "chk", dt.date(2024, 2, 29), 1608), (1, "sav", dt.date(2024, 2, 29), 5)],
                                       "owner_id long, account_id string, statement_date date, statement_balance_cents long")
    got = sorted((r.account_id, r.calculated_balance_cents, r.delta_cents, r.status) for r in closing.reconcile(statements, ledger, accounts).collect())
    assert got == [("chk", 1500, 100, "matched"), ("chk", 1507, 101, "discrepancy"), ("sav", 0, 5, "matched")]


def test_account_filter_states(make_ledger):
    ledger = make_ledger([("chk", "2024-01-01", 1, "a"), ("sav", "2024-01-01", 1, "a")])
    assert [scan.for_accounts(ledger, a).count() for a in (None, [], ["chk"])] == [2, 0, 1]
    assert scan.for_accounts_or_all(ledger, []).count() == 2


def test_stream_ingest_and_late_rows(spark, make_ledger, tmp_path):
    source, target, late = str(tmp_path / "in"), str(tmp_path / "ledger"), str(tmp_path / "late")
    first = make_ledger([("chk", "2024-01-05", -100, "a"), ("chk", "2024-02-05", -200, "b")])
    first.unionByName(first).write.parquet(source)
    stream = lambda: jobs.read_rows(spark, source, first.schema)
    jobs.ingest(stream(), target, str(tmp_path / "c1")).awaitTermination()
    assert jobs.current_ledger(spark, target).count() == 2

    closed = spark.createDataFrame([(1, "p1", dt.date(2024, 1, 1), dt.date(2024, 2, 1), None)],
                                   "owner_id long, closed_period_id string, period_start date, period_end date, account_filter array<string>")
    held = closing.close_fingerprints(closed, first)
    second = make_ledger([("chk", "2024-01-05", -100, "a"), ("chk", "2024-02-05", -200, "b"), ("chk", "2024-01-20", -300, "late")])
    for _ in range(2):  # sent twice, reported once
        second.write.mode("append").parquet(source)
        jobs.ingest(stream(), target, str(tmp_path / "c1")).awaitTermination()
        jobs.late_row_feed(stream(), closed, held, late, str(tmp_path / "c2")).awaitTermination()
    assert jobs.current_ledger(spark, target).count() == 3
    assert [r.fingerprint for r in spark.read.parquet(late).collect()] == ["f00002"]


def test_stream_ingest_takes_updates(spark, make_ledger, tmp_path):
    """A pending row posts with another date and amount, one posts unchanged, one has no source id."""
    source, target = str(tmp_path / "in"), str(tmp_path / "ledger")
    rows = [("chk", "2024-01-30", -100, "a"), ("chk", "2024-01-31", -200, "b"), ("chk", "2024-01-31", -300, "c")]
    blank = lambda df: df.withColumn("source_txn_id", F.when(F.col("merchant") != "c", F.col("source_txn_id")))
    first = blank(make_ledger(rows, pending=(0, 1)))
    moved = blank(make_ledger([("chk", "2024-02-02", -120, "a"), *rows[1:]]).withColumn("updated_at", F.lit("2024-02-03").cast("timestamp")))
    for batch in (first, moved):
        batch.write.mode("append").parquet(source)
        jobs.ingest(jobs.read_rows(spark, source, first.schema), target, str(tmp_path / "c")).awaitTermination()
    got = sorted((r.merchant, str(r.posted_at), r.amount_cents, r.pending, str(r.created_at)) for r in jobs.current_ledger(spark, target).collect())
    stamp = str(first.agg(F.max("updated_at")).first()[0])
    assert got == [("a", "2024-02-02", -120, False, stamp), ("b", "2024-01-31", -200, False, stamp), ("c", "2024-01-31", -300, False, stamp)]


def test_merge_knows_rows_without_fingerprint(spark, make_ledger):
    ledger = make_ledger([("chk", "2024-01-05", -100, "a"), ("chk", "2024-01-06", -200, "b")]).withColumn("fingerprint", F.lit(None).cast("string"))
    batch = ledger.filter("merchant = 'a'").withColumn("page_no", F.lit(1))
    merged = merge.merge_ledger(ledger, batch, "2024-03-01 00:00:00", keys=["owner_id"])
    assert {r.change for r in merged.collect()} == {"unchanged"} and merged.count() == 2


def test_large_amounts_pass(spark, make_ledger):
    """One charge of over ten million dollars among the others of a merchant."""
    rows = [("chk", f"2024-0{m}-05", -5000, "a") for m in range(1, 6)] + [("chk", "2024-06-05", -150_000_000_000, "a")]
    got = recurring.merchant_patterns(make_ledger(rows), "2024-06-30").collect()
    assert len(got) == 1 and got[0].amount_max_cents == 150_000_000_000


def test_search_counts_every_hit(spark, make_ledger, accounts):
    rows = [("chk", f"2024-01-{d:02}", -100, "Netflix") for d in range(1, 21)] + [("card", "2024-01-25", -100, "netflix")] * 4
    hits = scan.search(make_ledger(rows), accounts, "netflix", "2024-01-31", selected=["chk"], limit=5)
    assert hits.count() == 5
    assert [tuple(r) for r in scan.search_summary(hits, limit=5).collect()] == [(1, 20, 4, True)]


def test_audit_log_limits_each_ledger(spark):
    log = spark.createDataFrame([(o, "E", dt.datetime(2024, 1, 1, 0, k), "transaction", f"x{k}", "1") for o in (1, 2) for k in range(30)],
                                "owner_id long, event_type string, timestamp timestamp, entity_type string, entity_id string, new_value string")
    assert closing.audit_log(log).count() == 60
    assert closing.audit_log(log, limit=7).groupBy("owner_id").count().filter("count = 7").count() == 2
    assert closing.entity_history(log, "transaction", "x3").count() == 2


def test_containing_equals_a_plain_search(spark):
    import random

    r = random.Random(3)
    word = lambda low, high: "".join(r.choice("abc ") for _ in range(r.randint(low, high)))
    texts = [(r.choice([1, 2]), word(0, 14)) for _ in range(150)] + [(1, None), (2, "")]
    patterns = [(r.choice([1, 2]), word(0, 7)) for _ in range(120)] + [(1, None), (1, ""), (2, "zzzzz")]
    got = containing(spark.createDataFrame(texts, "o long, t string"), spark.createDataFrame(patterns, "o long, p string"), "t", "p", ["o"]).collect()
    want = {(o, t, p) for o, t in texts for q, p in patterns if o == q and t and p and p in t}
    assert len(got) == len(want) and {tuple(g) for g in got} == want


def test_a_registry_of_many_patterns(spark):
    """The longest of 20,000 patterns wins."""
    registry = spark.range(20_000).select(
        F.concat(F.lit("shop "), F.col("id").cast("string")).alias("pattern"), F.concat(F.lit("Shop "), F.col("id").cast("string")).alias("display_name"),
        F.lit("monthly").alias("service_cadence"), (-F.length(F.col("id").cast("string"))).alias("place"))
    rows = spark.createDataFrame([("the shop 12345 north",), ("shop",), ("shop 7",), (None,)], "merchant_norm string")
    got = {r.merchant_norm: r.service and r.service.display_name for r in classify.with_service(rows, registry=registry).collect()}
    assert got == {"the shop 12345 north": "Shop 12345", "shop": None, "shop 7": "Shop 7", None: None}


@pytest.mark.parametrize("sample, dialect", [
    ("Date,Amount,Description\n2024-01-01,-1.50,\"a; b; c; d\"\n2024-01-02,\"1,000.00\",x\n", (",", '"')),
    ("date;amount;description\n2024-01-01;1,50;a, b\n2024-01-02;2,50;c, d, e\n", (";", '"')),
    ("a|b\n1|2\n3|", ("|", '"')), ("a\tb\n'x\ty'\t2\n", ("\t", "'")), ("one column\nonly\n", (",", '"')), ("", (",", '"')),
])
def test_dialects(sample, dialect):
    assert bank_files.infer_dialect(sample) == dialect


def test_bank_file_with_line_ends_and_quotes(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text('transaction date;AMOUNT;Description\n1/2/2024;"($1,234.50)";"two\nlines; and ""quotes"""\n\n2024/01/03;;plain\n')
    parsed = bank_files.parse_bank_rows(bank_files.read_bank_csv(spark, str(path), "chk"))
    got = [(str(r.posted_at), r.amount_cents, r.description, r.place) for r in sorted(bank_files.preview(parsed).collect(), key=lambda r: r.place)]
    assert got == [("2024-01-02", -123450, 'two\nlines; and "quotes"', 1), ("2024-01-03", 0, "plain", 2)]
    assert bank_files.preview(parsed, rows=1).count() == 1


def test_ingest_reads_only_folders_of_its_accounts(spark, make_ledger, tmp_path):
    target = str(tmp_path / "ledger")
    rows = make_ledger([("chk", "2024-01-05", -100, "a", owner) for owner in range(40)])
    rows.write.parquet(str(tmp_path / "in"))
    jobs.ingest(jobs.read_rows(spark, str(tmp_path / "in"), rows.schema), target, str(tmp_path / "c")).awaitTermination()
    near = jobs.versions_near(rows.filter("owner_id = 7"), target, 99)
    filters = near._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in filters and "batch_id" in filters
    assert near.count() == 1


def test_days_of_months_and_ranges(spark):
    row = spark.sql("SELECT DATE '2024-02-10' AS d, DATE '2024-02-29' AS last").select(
        dates.days_left_in_month(F.col("d")), dates.days_left_in_month(F.col("last")), dates.days_in_range(F.col("d"), dates.exclusive_end(F.col("last"))),
        dates.previous_period_start(F.col("d"), "quarter")).first()
    assert tuple(row) == (20, 1, 20, dt.date(2023, 10, 1))
