"""What large ledgers must not do: broadcast what only looks small, cut few texts into pieces, judge a text once a group."""

import datetime as dt
import time
import types

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tallywork import session
from tallywork.catalog import reports
from tallywork.operators import classify, containment, merge, pairing, refunds, scan, search_index
from tallywork.plans import period_report as pr
from tallywork.streaming import jobs

ROWS = [("chk", "2001-01-05", -5000, "Online transfer"), ("sav", "2001-01-06", 5000, "Savings deposit"), ("card", "2001-01-07", -2500, "Shop one"),
        ("card", "2001-01-20", 2500, "Shop one refund"), ("chk", "2001-02-01", 90000, "ACME payroll"), ("chk", "2001-02-02", -700, "Netflix.com"),
        ("chk", "2001-02-03", -700, "Chase Card Autopay")]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranges_are_not_broadcast(spark, make_ledger):
    day = dt.date.fromisoformat
    ranges = spark.createDataFrame([(1, "r", day("2001-01-05"), day("2001-02-01"))], "owner_id long, range_id string, first_day date, last_day date")
    totals = scan.user_range_totals(make_ledger(ROWS), ranges)
    assert "Broadcast" not in plan(totals)
    assert [(r.row_count, r.income_cents, r.spend_cents) for r in totals.collect()] == [(5, 97500, 7500)]


def test_few_texts_are_compared_as_they_are(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "abcdef"), (1, "xy"), (2, "abcdef"), (None, "abc")], "o long, t string")
    patterns = spark.createDataFrame([(1, "bcde"), (1, "x"), (2, "zz"), (2, "f"), (None, "abc")], "o long, p string")
    wanted = [(1, "abcdef", "bcde"), (1, "xy", "x"), (2, "abcdef", "f")]
    direct = containment.containing(texts, patterns, "t", "p", ["o"])
    assert "Generate" not in plan(direct) and sorted(map(tuple, direct.collect())) == wanted
    for most in (0, 2):  # all by pieces, some
        monkeypatch.setattr(containment, "DIRECT_MOST", most)
        assert sorted(map(tuple, containment.containing(texts, patterns, "t", "p", ["o"]).collect())) == wanted


def test_matches_read_stored_rows(make_ledger):
    ledger = make_ledger(ROWS)
    for found in (pairing.transfer_pairs(ledger), refunds.refund_matches(ledger)):
        assert "ExistingRDD" not in plan(found)
        assert found.count() == 1
    assert sorted(pairing.transfer_pairs(ledger, stored=True).collect()) == sorted(pairing.transfer_pairs(ledger).collect())
    assert sorted(refunds.refund_matches(ledger, stored=True).collect()) == sorted(refunds.refund_matches(ledger).collect())


def test_accounts_are_looked_up_where_the_type_hangs_on_them(make_ledger, accounts):
    rows = scan.with_merchant_norm(make_ledger(ROWS))
    some = classify.with_card_flag(rows, accounts, classify.reads_card_flag())
    assert {r.fingerprint: r.is_card for r in some.collect()} == {
        "f00000": None, "f00001": False, "f00002": None, "f00003": True, "f00004": False, "f00005": None, "f00006": False}
    types = lambda flagged: sorted((r.fingerprint, r.txn_type, r.reason_code) for r in classify.classify(flagged).collect())
    assert types(some) == types(classify.with_card_flag(rows, accounts))


def test_texts_are_judged_once(make_ledger):
    scanned = pr.scan_categories(make_ledger(ROWS))
    assert "RLIKE" not in plan(scanned).upper()
    assert {r.merchant_norm: r.category for r in scanned.collect()}["netflix.com"] == "entertainment"


def test_scopes_in_one_pass(make_ledger, accounts):
    rows, scopes = pr.classified_ledger(make_ledger(ROWS), accounts), ["income", "spend", "net", "transfer", "merchant:netflix.com", "category:entertainment"]
    table = pr.drill_down_table(rows, scopes)
    for scope in scopes:
        alone = pr.drill_down_totals(rows, scope)
        assert sorted(map(tuple, table.filter(F.col("scope") == scope).select(*alone.columns).collect())) == sorted(map(tuple, alone.collect()))


def test_a_batch_without_repeats_is_not_shuffled(spark, make_ledger, monkeypatch):
    rows = make_ledger(ROWS)
    alone = merge.last_arrivals(rows, "updated_at", ["owner_id"])
    assert "Exchange" not in plan(alone) and sorted(alone.collect()) == sorted(rows.collect())
    odd = rows.withColumn("source_txn_id", F.when(F.col("amount_cents") < 0, F.lit(None).cast("string")).otherwise(F.lit("")))
    later = rows.withColumn("updated_at", F.expr("updated_at + interval 1 day")).withColumn("amount_cents", F.col("amount_cents") + 1)
    batch = rows.unionByName(later.filter("amount_cents < 0")).unionByName(odd).unionByName(odd.withColumn("owner_id", F.lit(None).cast("long")))
    latest = Window.partitionBy("owner_id", "account_id", "slot").orderBy(F.desc("updated_at"), F.desc("fingerprint"))
    want = merge.with_slots(batch).withColumn("n", F.row_number().over(latest)).filter("n = 1").drop("n", "slot")
    for most in (merge.AGAIN_MOST, 1):  # repeats looked up by hash, the whole batch sorted
        monkeypatch.setattr(merge, "AGAIN_MOST", most)
        got = merge.last_arrivals(batch, "updated_at", ["owner_id"])
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_newest_versions_shuffle_what_is_read(spark, make_ledger, tmp_path):
    path, rows = str(tmp_path / "ledger"), make_ledger(ROWS).withColumn("change", F.lit("inserted"))
    rows.withColumn("batch_id", F.lit(0)).withColumn("bucket", F.lit(1)).write.partitionBy("batch_id", "bucket").parquet(path)
    rows.limit(2).withColumn("amount_cents", F.lit(7)).withColumn("batch_id", F.lit(1)).withColumn("bucket", F.lit(1)).write.mode("append").partitionBy("batch_id", "bucket").parquet(path)
    current = jobs.current_ledger(spark, path).select("fingerprint", "amount_cents")
    assert "created_at" not in plan(current) and "description" not in plan(current)
    assert [r.amount_cents for r in sorted(current.collect())] == [7, 7] + [r[2] for r in ROWS[2:]]


def test_a_streamed_batch_is_not_kept(spark, make_ledger, tmp_path, monkeypatch):
    def kept(*_):
        raise AssertionError("a batch may be the whole ledger")
    monkeypatch.setattr(DataFrame, "persist", kept)
    jobs._merge_batch(str(tmp_path / "ledger"), ["owner_id"], "updated_at")(make_ledger(ROWS), 0)
    assert jobs.current_ledger(spark, str(tmp_path / "ledger")).count() == len(ROWS)


def test_the_index_holds_a_text_once_for_all_ledgers(spark, make_ledger, tmp_path):
    ledger, path = make_ledger([(*row, owner) for row in ROWS for owner in range(1, 6)]), str(tmp_path / "index")
    search_index.build(ledger, path)
    assert spark.read.parquet(f"{path}/texts").count() == len({row[3] for row in ROWS})
    assert spark.read.parquet(f"{path}/rows").count() == ledger.count()
    found = search_index.rows_holding(spark, path, "netflix").select("owner_id", "amount_cents").collect()
    assert sorted(map(tuple, found)) == [(owner, -700) for owner in range(1, 6)]


def shuffle_files(spark) -> int:
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(1 for k in range(found.size()) if found.apply(k).getName().endswith(".data"))


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before, set_to = shuffle_files(spark), spark.conf.get(session.FREE_SHUFFLES, None)
    stored = session.store(spark.range(1000).repartition(3, "id"))
    until = time.monotonic() + 20
    while shuffle_files(spark) > before and time.monotonic() < until:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert stored.count() == 1000 and spark.conf.get(session.FREE_SHUFFLES, None) == set_to


def test_full_reports_read_stored_pairs_and_refunds(spark, make_ledger, accounts, monkeypatch):
    seen = []
    monkeypatch.setattr(reports, "store", lambda df: seen.append(df.columns) or session.store(df))
    none = spark.createDataFrame([], "owner_id long, fingerprint string, merchant_pattern string, target_type string, rule_order int, rule_type string")
    x = types.SimpleNamespace(stored=session.store(make_ledger(ROWS)), accounts=accounts, rules=lambda *_: none)
    x.stored_patterns = spark.createDataFrame([], "owner_id long, merchant_norm string, is_transfer boolean, is_recurring boolean, is_habitual boolean, cadence string")
    rows = reports.full_rows(x).collect()
    assert ["out_fingerprint" in c for c in seen] == [True, False] and "refund_fingerprint" in seen[1]
    assert len(rows) == len(ROWS) and sorted(r.fingerprint for r in rows if r.is_paired) == ["f00000", "f00001"]
