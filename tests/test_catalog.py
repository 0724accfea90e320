"""Registered queries against their SQL on the smallest driver tables."""

import pathlib

import duckdb
import pytest

from tallywork.catalog import CATALOG

FOLDER = "/root/testdata/sf0.001"
TABLES = ["customer", "orders", "lineitem", "events"]
SAMPLE = ["period_totals", "monthly_reports", "classified_rows", "merchant_patterns", "transfer_candidates", "alert_feed",
          "statement_reconciliation", "month_close", "ledger_merge", "parsed_bank_rows", "commitment_board", "spending_plan",
          "transfer_pairs", "refund_matches", "full_period_report", "account_filtered_report", "empty_account_choice", "transaction_search", "audit_log",
          "bank_files_read_back", "bank_file_preview", "bank_file_counts", "income_by_rule_file", "user_range_totals", "last_day_included",
          "streamed_ledger", "streamed_late_rows", "indexed_search", "incremental_month_close", "incremental_snapshot_ids", "incremental_period_totals",
          "full_period_trends", "full_integrity_scores", "five_label_analysis_with_patterns"]

pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_check(spark, con, name):
    query = CATALOG[name]
    order = lambda row: tuple((v is not None, str(v)) for v in row)
    got = sorted((tuple(r) for r in query.run(spark, FOLDER).collect()), key=order)
    assert got == sorted(con.execute(query.check_text()).fetchall(), key=order)


def test_no_cross_products(spark):
    """Reports and patterns plan no product of two tables of rows."""
    for name in ("transfer_candidates", "refund_candidates", "cross_account_duplicates", "duplicate_charges", "late_rows"):
        plan = CATALOG[name].run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
