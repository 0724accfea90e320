"""Tables that queries keep beside the ledger: month states and the search index."""

import datetime as dt
import pathlib

from pyspark.sql import functions as F

from tallywork.operators import scan, search_index
from tallywork.plans import closing, month_states
from tallywork.plans import period_report as pr


def test_a_batch_recomputes_its_months_only(spark, make_ledger, accounts, tmp_path):
    path = str(tmp_path / "states")
    rows = [("chk", dt.date(2024, m, d), -100 * d, f"shop {d % 3}", owner) for m in (1, 2, 3) for d in (1, 7, 7, 31 if m != 2 else 29) for owner in (1, 2)]
    before = make_ledger(rows)
    month_states.write_states(month_states.month_states(before, accounts), path)
    files = lambda month: sorted((p.name, p.stat().st_mtime_ns) for p in pathlib.Path(path, f"month={month}").glob("*.parquet"))
    old = {m: files(f"2024-0{m}-01") for m in (1, 2, 3)}
    batch = make_ledger([("chk", dt.date(2024, 2, 15), 5000, "acme payroll"), ("chk", dt.date(2024, 4, 2), -900, "new month", 2)]).withColumn(
        "fingerprint", F.concat(F.lit("late"), "fingerprint"))
    after = before.unionByName(batch)
    assert month_states.refresh(path, after, batch, accounts) == [dt.date(2024, 2, 1), dt.date(2024, 4, 1)]
    assert files("2024-01-01") == old[1] and files("2024-03-01") == old[3] and files("2024-02-01") != old[2]

    states = month_states.read_states(spark, path)
    same = lambda a, b: sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))
    assert same(month_states.month_close(states), closing.month_close(after))
    assert same(month_states.snapshot_ids(states), closing.snapshot_ids(after))
    assert same(month_states.period_totals_of(states), pr.period_totals(pr.classified_ledger(after, accounts, with_categories=False)))
    assert month_states.refresh(path, after, batch.limit(0), accounts) == []


def test_search_index_finds_what_a_scan_finds(spark, make_ledger, accounts, tmp_path):
    path = str(tmp_path / "index")
    names = ["Netflix.com", "NETFLIX inc", "Café Zoë", "nets", "a", "", None, "flix"]
    ledger = make_ledger([("chk", dt.date(2024, 1, 1 + k % 28), -100 - k, names[k % len(names)] or "", 1 + k % 3) for k in range(120)])
    ledger = ledger.withColumn("merchant", F.when(F.col("amount_cents") % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("merchant")))
    search_index.build(ledger, path)
    for needle in ("netflix", "NETFLIX", "fé z", "x", "zzz", "net", "."):
        found = search_index.rows_holding(spark, path, needle)
        want = scan.search(ledger, accounts, needle, "2024-01-31", limit=1000)
        got = scan.search(found, accounts, needle, "2024-01-31", limit=1000)
        assert sorted(r.fingerprint for r in got.collect()) == sorted(r.fingerprint for r in want.collect()), needle
    plan = search_index.rows_holding(spark, path, "netflix inc")._jdf.queryExecution().executedPlan().toString()
    assert "row_folder" in plan.split("PartitionFilters: [")[1].split("]")[0]
