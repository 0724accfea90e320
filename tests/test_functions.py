import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallywork.functions import dates, money, text
from tallywork.sources.bank_files import detect_bank, parse_date


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_parse_cents(spark):
    rows = [("12.99",), ("-12.99",), ("0.125",), ("-0.125",), ("1,234.56",), ("",), (None,), ("x",), ("1000000",), ("1000001",)]
    got = values(spark, rows, "t string", money.parse_cents(F.col("t")), money.parse_cents(F.col("t"), allow_large=True))
    assert [g[0] for g in got] == [1299, -1299, 13, -13, 123456, None, None, None, 100000000, None]
    assert got[-1][1] == 100000100


def test_statement_amounts(spark):
    rows = [("(12.50)",), ("$1,234.50",), ("- 3.00",), ("",), (None,), ("n/a",)]
    assert [v for v, in values(spark, rows, "t string", money.parse_statement_cents(F.col("t")))] == [-1250, 123450, -300, 0, 0, None]


def test_formats_and_rounding(spark):
    c = F.col("c")
    got = values(spark, [(1299,), (-123456,), (5000,), (0,)], "c long", money.format_usd(c), money.format_usd(c, show_sign=True),
                 money.format_usd_compact(c), money.divide_cents(c, 2), money.multiply_cents(c, 0.5))
    assert got[0] == ("$12.99", "+$12.99", "$12.99", 650, 650)
    assert got[1][:3] == ("-$1,234.56", "-$1,234.56", "-$1,234.56")
    assert got[2][2] == "$50" and got[3][0] == "$0.00"


@pytest.mark.parametrize("cadence,want", [("annual", 100), ("quarterly", 400), ("bimonthly", 600), ("weekly", 5200), ("biweekly", 2600), ("monthly", 1200)])
def test_monthly_equivalent(spark, cadence, want):
    assert values(spark, [(1200, cadence)], "c long, k string", money.monthly_equivalent(F.col("c"), F.col("k"))) == [(want,)]


def test_threshold(spark):
    got = values(spark, [(100, 103), (1000, 1100), (0, 0)], "a long, b long", money.within_threshold(F.col("a"), F.col("b")),
                 money.within_threshold(F.col("a"), F.col("b"), 3), money.within_threshold(F.col("a"), F.col("b"), 0, 10.0))
    assert got == [(False, True, True), (False, False, True), (True, True, True)]


def next_monthly_by_hand(last, after):
    year, month = last.year, last.month
    while True:
        month += 1
        if month > 12:
            year, month = year + 1, 1
        last_day = (dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)).day
        day = dt.date(year, month, min(last.day, last_day))
        if day >= after:
            return day


def test_next_monthly(spark):
    start = dt.date(2020, 1, 29)
    rows = [(start + dt.timedelta(days=i * 3), start + dt.timedelta(days=(i * 37) % 500)) for i in range(200)]
    got = values(spark, rows, "a date, b date", dates.next_monthly(F.col("a"), F.col("b")))
    assert [g for g, in got] == [next_monthly_by_hand(a, b) for a, b in rows]


def test_next_due(spark):
    today, ref = dt.date(2024, 3, 14), dt.date(2024, 3, 1)
    rows = [("monthly", 31, None), ("monthly", None, ref), ("weekly", None, ref), ("biweekly", None, ref), ("quarterly", None, ref),
            ("annual", None, ref), ("one_time", None, ref), ("weekly", None, None)]
    got = values(spark, [(*r, today) for r in rows], "c string, d int, r date, t date",
                 dates.next_due(F.col("c"), F.col("d"), F.col("r"), F.col("t")))
    assert [g for g, in got] == [dt.date(2024, 4, 30), dt.date(2024, 4, 1), dt.date(2024, 3, 15), dt.date(2024, 3, 15), dt.date(2024, 5, 31),
                                 dt.date(2025, 3, 1), None, None]


def test_week_key(spark):
    days = [dt.date(2023, 12, 25) + dt.timedelta(days=i) for i in range(800)]
    got = values(spark, [(d,) for d in days], "d date", dates.monday_week_key(F.col("d")))
    assert [g for g, in got] == [d.strftime("%Y-%W") for d in days]


def test_periods_have_no_gaps(spark):
    for period in ("month", "quarter", "year"):
        d = F.col("d")
        rows = values(spark, [(dt.date(2023, 11, 1) + dt.timedelta(days=i),) for i in range(500)], "d date", dates.period_start(d, period),
                      dates.period_end(d, period), dates.previous_period_start(d, period))
        spans = sorted(set(rows))
        assert all(a[1] == b[0] and b[2] == a[0] for a, b in zip(spans, spans[1:]))


def test_merchants(spark):
    rows = [("amazon", "amazon marketplace"), ("amazon.com", "amazon prime"), ("shell", "chevron"), ("", "x"), ("a b", "a b")]
    got = values(spark, rows, "a string, b string", text.merchants_match(F.col("a"), F.col("b")), text.merchant_similarity(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [True, True, False, False, True]
    assert [round(g[1], 3) for g in got] == [0.9, 0.5, 0.0, 0.0, 1.0]


def test_fuzzy_and_keys(spark):
    rows = [("NETFLIX.COM",), ("netflix inc",), ("amazon*prime",), ("shop  12345",)]
    assert [g for g, in values(spark, rows, "m string", text.fuzzy_key(F.col("m")))] == ["netflix", "netflix", "amazon", "shop"]
    key = text.split_alert_key(F.lit("test_charge|a|b co|100|2024-01-02"))
    assert spark.range(1).select(key).first()[0].asDict() == {
        "pattern_type": "test_charge", "merchant_norm": "a|b co", "amount_cents": 100, "posted_at": dt.date(2024, 1, 2)}


def test_csv_guard(spark):
    rows = [("=1+1",), ("-5",), ("ok",), (None,), ("@x",)]
    assert [g for g, in values(spark, rows, "t string", text.csv_safe(F.col("t")))] == ["'=1+1", "'-5", "ok", "", "'@x"]


def test_dates_and_banks(spark):
    rows = [("2024-01-02",), ("1/2/2024",), ("25/12/2024",), ("01-02-2024",), ("2024/1/2",), ("2024-13-01",), ("soon",), (None,)]
    got = [g for g, in values(spark, rows, "t string", parse_date(F.col("t")))]
    assert got == [dt.date(2024, 1, 2), dt.date(2024, 1, 2), dt.date(2024, 12, 25), dt.date(2024, 1, 2), dt.date(2024, 1, 2), None, None, None]
    assert detect_bank(["transaction date", "AMOUNT", "Description"]) == "chase"
    assert detect_bank(["Transaction Date", "Debit", "Description"]) == "capitalone"
    assert detect_bank(["a", "b"]) is None
