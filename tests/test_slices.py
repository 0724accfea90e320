"""Queries run by slices of the ledgers: the same rows, and nothing left on disk but them."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tallywork import session
from tallywork.catalog import CATALOG
from tallywork.operators import merge
from tallywork.sources import bank_files, driver_ledger

FULL = ["full_period_report", "fully_classified_rows", "resolution_tasks", "drill_down_scopes", "full_month_summary", "full_month_verdicts",
        "full_integrity_scores", "full_resolution_tasks"]
FILTERED = ["account_filtered_report", "account_filtered_transfers", "classified_with_overrides"]
MATCHED = ["unmatched_transfer_legs", "refund_matches", "refund_table", "unmatched_refunds", "category_net_of_refunds"]
FILES = ["bank_files_read_back", "bank_file_preview", "bank_file_counts", "streamed_ledger", "incremental_month_close", "incremental_snapshot_ids",
         "incremental_period_totals", "bank_import_counts"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Six customers and one that is null, orders of them and of one that is no customer, line items of them and of no order."""
    folder = str(tmp_path_factory.mktemp("tables"))
    day = lambda n: dt.datetime(2001, 1, 1) + dt.timedelta(days=7 * n)
    orders = [(k, None if k == 11 else 77 if k == 12 else k % 6 + 1, 1000.0 + 3 * k, day(k), ["1-URGENT", "2-HIGH", "3-MEDIUM"][k % 3]) for k in range(36)]
    items = [(k, 40 * n + 7 + 12 * (n % 3), 3 + n % 2, n, 5.0, 900.0 + 10 * (k % 4), 0.05, 0.02, "RN"[n % 2], "FO"[n % 2], day(k + n)) for k in (*range(36), 99) for n in range(1, 5)]
    spark.createDataFrame([(k,) for k in [*range(1, 7), None]], "c_custkey long").coalesce(1).write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string").coalesce(1).write.parquet(
        f"{folder}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def in_three(monkeypatch, spark, tables):
    monkeypatch.setattr(driver_ledger, "ROWS_A_SLICE", 80)
    monkeypatch.setattr(driver_ledger, "SLICES_A_PART", 2)
    assert driver_ledger.slice_count(spark, tables) == 3


def test_parts_hold_every_ledger_row_once(spark, tables, monkeypatch):
    whole = rows_of(driver_ledger.ledger(spark, tables))
    in_three(monkeypatch, spark, tables)
    parts = list(driver_ledger.ledger_parts(spark, tables))
    assert len(parts) == 2 and all(not p.isEmpty() for p in parts)
    assert rows_of(parts[0].unionAll(parts[1])) == whole


@pytest.mark.parametrize("name", [FULL[1], FILTERED[0], MATCHED[4], FILES[0], FILES[3], FILES[7]])
def test_slices_give_the_rows_of_one_run(spark, tables, monkeypatch, name):
    once = rows_of(CATALOG[name].run(spark, tables))
    in_three(monkeypatch, spark, tables)
    made = []
    monkeypatch.setattr(session, "uuid", type("names", (), {"uuid4": staticmethod(lambda real=session.uuid.uuid4: made.append(real()) or made[-1])}))
    sliced = CATALOG[name].run(spark, tables)
    assert once and rows_of(sliced) == once
    # Of all folders made, the one with the rows is left.
    within = f"{session.shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"
    left = {n for n in os.listdir(within) if any(u.hex in n for u in made)}
    assert {n.split("-")[0] for n in left} <= {"slices", "table"} and sum(n.startswith("slices") for n in left) == 1
    assert sorted(n for n in os.listdir(f"{within}/{[n for n in left if n.startswith('slices')][0]}")) == ["0", "1", "2"]


def test_every_query_over_whole_ledgers_is_sliced():
    assert all(CATALOG[name].read for name in FULL + FILTERED + MATCHED + FILES)


def test_a_scratch_goes_with_its_tables(spark):
    with session.scratch(spark) as folder:
        inner = session.store(spark.range(3))
        assert inner.count() == 3 and os.path.isdir(folder)
    kept = session.store(spark.range(4))
    assert not os.path.exists(folder) and kept.count() == 4


def test_stored_digests_take_half_their_length(spark, tmp_path):
    digests = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("fingerprint")).coalesce(1)
    session.write(digests, str(tmp_path / "t"))
    assert sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet")) < 20_000 * 20


def test_bank_rows_are_read_once(spark):
    rows = spark.createDataFrame([(1, "a", "2024-01-02", "$1.50", "shop", None), (2, "a", "soon", "2", "shop", None), (3, "a", "1/2/2024", "n/a", "shop", None)],
                                 "owner_id long, account_id string, date_text string, amount_text string, description string, merchant string")
    good = bank_files.accepted(bank_files.parse_bank_rows(rows))
    assert [(r.owner_id, str(r.posted_at), r.amount_cents) for r in good.collect()] == [(1, "2024-01-02", 150)]
    text = good.select("owner_id", "fingerprint")._jdf.queryExecution().optimizedPlan().toString().upper()
    assert text.count("REGEXP_REPLACE") == 4 and text.count("RLIKE") == 6  # as often as the reading itself names them


def test_a_null_key_or_print_is_never_known(spark):
    batch = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, None), (None, "a"), (2, "a")], "owner_id long, fingerprint string")
    ledger = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (None, "a"), (3, "a")], "owner_id long, fingerprint string")
    counts = merge.import_counts(batch, ledger, ["owner_id"])
    assert sorted(counts.collect(), key=str) == sorted([(1, 2, 2), (None, 1, 0), (2, 1, 0)], key=str)
    assert counts._jdf.queryExecution().executedPlan().toString().count("Join") == 0
