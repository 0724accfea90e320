"""What keeps a task's rows and a ledger's shuffles in step with the input."""

from pyspark.sql import functions as F

from tallywork import session
from tallywork.operators import commitments, matching
from tallywork.plans import period_report as pr
from tallywork.sources import driver_ledger

PARTITIONS = "spark.sql.shuffle.partitions"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitions_grow_with_the_tables_and_never_shrink(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_PARTITION", 4)
    given = spark.conf.get(PARTITIONS)
    try:
        session.enough_partitions(spark.range(10), spark.range(11))
        assert spark.conf.get(PARTITIONS) == "6"
        session.enough_partitions(spark.range(2))
        assert spark.conf.get(PARTITIONS) == "6"
    finally:
        spark.conf.set(PARTITIONS, given)


def test_customers_of_one_row_group_are_dealt_to_tasks(spark, monkeypatch, tmp_path):
    spark.range(25).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert driver_ledger.spread_customers(spark, str(tmp_path)).rdd.getNumPartitions() == 1
    monkeypatch.setattr(driver_ledger, "CUSTOMERS_A_TASK", 10)
    dealt = driver_ledger.spread_customers(spark, str(tmp_path))
    assert dealt.rdd.getNumPartitions() == 3
    assert sorted(r.c_custkey for r in dealt.collect()) == list(range(25))


def test_numbering_reads_rows_by_one_exchange(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", None), ("b", "3")], "lot string, row_id string")
    found = matching.numbered(rows, "lot", "row_id")
    assert not [line for line in plan(found).splitlines() if "Filter" in line and "md5" in line]
    places = sorted((r.lot, r.place) for r in found.collect())
    assert places == [("a", 1), ("a", 2), ("b", 0)]  # a row without an id takes a place and is left out


def test_commitments_read_the_ledger_once(spark, make_ledger):
    rows = make_ledger([("chk", f"2001-0{m}-05", -1500, "Netflix") for m in range(1, 6)])
    items = spark.createDataFrame([(1, 1, "Films", "netflix", 5, "detected", "expense")],
                                  "owner_id long, commitment_id long, name string, merchant_norm string, day_of_month int, source string, direction string")
    found = commitments.matching_rows(items.withColumn("expected_cents", F.lit(None).cast("long")), rows)
    assert "ExistingRDD" not in plan(found)
    assert [(r.anchor, r.months_seen) for r in found.collect()] == [(1500, 5)] * 5


def test_rows_are_joined_by_fingerprint_then_by_merchant(spark, make_ledger, accounts):
    rows = make_ledger([("chk", "2001-01-05", -1500, "Netflix"), ("chk", "2001-01-06", -900, "Shop")])
    overrides = spark.createDataFrame([(1, "f00001", None, "REFUND", 0), (1, None, "netflix", "TRANSFER", 1)],
                                      "owner_id long, fingerprint string, merchant_pattern string, target_type string, rule_order int")
    patterns = spark.createDataFrame([(1, "shop", False, False, True, "")],
                                     "owner_id long, merchant_norm string, is_transfer boolean, is_recurring boolean, is_habitual boolean, cadence string")
    typed = pr.classified_ledger(rows, accounts, patterns=patterns, type_overrides=overrides, with_categories=False)
    joins = [line for line in plan(typed.select("fingerprint", "txn_type", "spending_bucket")).splitlines() if "LeftOuter" in line]
    by = ["merchant" if "merchant_norm" in line else "fingerprint" for line in joins if "merchant_norm" in line or "fingerprint" in line]
    assert by == ["merchant", "merchant", "fingerprint"]  # from the last join to the first
    assert sorted((r.fingerprint, r.txn_type) for r in typed.collect()) == [("f00000", "TRANSFER"), ("f00001", "REFUND")]
