"""A ledger over the driver's tables, so that every operator has rows that grow with them.

The SQL text is shared by Spark and by the SQL used to check results; only the
series function differs. Line items give card and checking charges, orders give
transfer legs and payroll, customers give recurring streams and spot patterns.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import enough_partitions

AS_OF = "2001-11-05"
TABLES = ("customer", "orders", "lineitem", "events")

MERCHANTS = [
    "Kroger", "Starbucks Coffee", "Shell Gas Station", "Uber Trip", "NETFLIX.COM",
    "Amazon.com", "Amazon Prime Video", "Target", "Walmart Supercenter", "CVS Pharmacy",
    "GEICO Insurance", "Comcast Xfinity", "City of Austin Utilities", "City of Austin Parking", "Planet Fitness Gym",
    "Adobe Creative Cloud", "Delta Airlines", "Marriott Hotel", "Udemy Course", "Great Clips Salon",
    "PetSmart", "Red Cross Donation", "Overdraft Fee", "Zelle payment to Ann", "Venmo Cashout",
    "Chase Card Autopay", "Payment Thank You", "ACH transfer to savings", "State Farm", "Home Depot",
    "Spotify USA", "Hulu", "Disney Plus", "Google One Storage", "YouTube Premium",
    "Apple.com/bill iCloud", "Microsoft 365", "PayPal *eBay", "Joe's Pizza", "Coach Outlet",
]

_MERCHANT_ROWS = ", ".join("({}, '{}')".format(i, m.replace("'", "''")) for i, m in enumerate(MERCHANTS))

# Spot patterns near the end of the ledger: customer modulus, days back, cents, account, merchant.
_SPOT_ROWS = """
    (9, 20, -2599, 1, 'Cloud Storage Co'), (9, 18, -2599, 1, 'Cloud Storage Co'),
    (11, 12, -100, 1, 'Verify Svc'), (12, 9, -10000, 1, 'Gift Emporium'),
    (10, 7, -450, 1, 'Coffee Kiosk'), (10, 7, -475, 1, 'Coffee Kiosk'),
    (10, 7, -425, 1, 'Coffee Kiosk'), (10, 6, -450, 1, 'Coffee Kiosk'),
    (8, 25, 5000, 1, 'Online Outfitters'), (8, 22, -4800, 1, 'Online Outfitters'),
    (7, 30, -6200, 0, 'Harbor Grill'), (7, 29, -6200, 1, 'Harbor Grill Austin'),
    (6, 40, -1599, 1, 'Garden Supply Refunds'), (6, 33, 1599, 1, 'Garden Supply refund'),
    (5, 3, -99900, 1, 'Water Utility District')
"""

_LEDGER_SQL = """
    SELECT
        owner_id,
        concat('acct-', CAST(owner_id AS STRING), '-', CAST(acct AS STRING)) AS account_id,
        posted_at,
        amount_cents,
        'USD' AS currency,
        description,
        merchant,
        source_txn_id,
        md5(concat_ws('|', source_txn_id, CAST(owner_id AS STRING), CAST(acct AS STRING),
            CAST(posted_at AS STRING), CAST(amount_cents AS STRING))) AS fingerprint,
        pending,
        CAST(posted_at + 1 AS TIMESTAMP) AS created_at,
        CAST(posted_at + CAST(1 + amount_cents % 2 * amount_cents % 2 AS INT) AS TIMESTAMP) AS updated_at
    FROM (
        SELECT
            o.o_custkey AS owner_id,
            CAST(l.l_linenumber % 2 AS INT) AS acct,
            CAST(l.l_shipdate AS DATE) AS posted_at,
            CAST(CASE WHEN l.l_returnflag = 'R' THEN round(l.l_extendedprice) ELSE -round(l.l_extendedprice) END AS BIGINT) AS amount_cents,
            concat(m.name, ' #', CAST(l.l_suppkey % 20 AS STRING)) AS description,
            CASE WHEN l.l_partkey % 13 = 0 THEN '' ELSE m.name END AS merchant,
            concat_ws('-', 'li', CAST(l.l_orderkey AS STRING), CAST(l.l_linenumber AS STRING), CAST(l.l_partkey AS STRING),
                CAST(l.l_suppkey AS STRING), CAST(CAST(round(l.l_quantity) AS BIGINT) AS STRING),
                CAST(CAST(round(l.l_extendedprice * 100) AS BIGINT) AS STRING),
                CAST(CAST(round(l.l_discount * 100) AS BIGINT) AS STRING),
                CAST(CAST(round(l.l_tax * 100) AS BIGINT) AS STRING)) AS source_txn_id,
            l.l_linestatus = 'O' AND CAST(l.l_shipdate AS DATE) >= DATE '2001-10-01' AS pending
        FROM {lineitem} l
        JOIN {orders} o ON l.l_orderkey = o.o_orderkey
        JOIN (VALUES {merchant_rows}) AS m(k, name) ON m.k = l.l_partkey % 40

        UNION ALL
        SELECT o_custkey, 0, CAST(o_orderdate AS DATE), -(CAST(round(o_totalprice) AS BIGINT) % 200000 + 1000),
            CASE WHEN o_orderkey % 3 = 0 THEN 'Cabinet maker' ELSE 'Online transfer to savings' END,
            CASE WHEN o_orderkey % 3 = 0 THEN 'Cabinet maker' ELSE 'Online transfer' END,
            concat('out-', CAST(o_orderkey AS STRING)), FALSE
        FROM {orders} WHERE o_orderpriority = '2-HIGH'
        UNION ALL
        SELECT o_custkey, 2, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT),
            CAST(round(o_totalprice) AS BIGINT) % 200000 + 1000 + o_orderkey % 4 * 100,
            'Savings deposit', 'Savings deposit', concat('in-', CAST(o_orderkey AS STRING)), FALSE
        FROM {orders} WHERE o_orderpriority = '2-HIGH'
        UNION ALL
        SELECT o_custkey, 0, CAST(o_orderdate AS DATE), 150000 + o_orderkey % 50 * 1000,
            'ACME Corp payroll', 'ACME Corp Payroll', concat('pay-', CAST(o_orderkey AS STRING)), FALSE
        FROM {orders} WHERE o_orderpriority = '1-URGENT'

        UNION ALL
        SELECT c_custkey, 1, make_date(2000 + CAST(floor((10 + i) / 12) AS INT), CAST((10 + i) % 12 + 1 AS INT), CAST(1 + c_custkey % 28 AS INT)),
            -(CASE WHEN c_custkey % 7 = 0 AND i >= 10 THEN 1899 ELSE 1499 END + c_custkey % 5 * 100),
            'NETFLIX.COM CA', 'NETFLIX.COM', concat('sub-', CAST(c_custkey AS STRING), '-', CAST(i AS STRING)), FALSE
        FROM {customer} {months}
        UNION ALL
        SELECT c_custkey, 0, make_date(2000 + CAST(floor((10 + i) / 12) AS INT), CAST((10 + i) % 12 + 1 AS INT), 12),
            -(4500 + (c_custkey * 31 + i * 517) % 3000),
            'Bill', 'Water Utility District', concat('util-', CAST(c_custkey AS STRING), '-', CAST(i AS STRING)), FALSE
        FROM {customer} {months}
        UNION ALL
        SELECT c_custkey, 0, DATE '2000-11-10' + CAST(i * 28 + c_custkey % 3 AS INT), 250000 + c_custkey % 40 * 500,
            'Direct deposit', 'Globex Salary', concat('job-', CAST(c_custkey AS STRING), '-', CAST(i AS STRING)), FALSE
        FROM {customer} {months}
        UNION ALL
        SELECT c_custkey, 1, make_date(2000 + CAST(floor((10 + i) / 12) AS INT), CAST((10 + i) % 12 + 1 AS INT), 20), -1599,
            'NETFLIX INC', 'NETFLIX INC', concat('sub2-', CAST(c_custkey AS STRING), '-', CAST(i AS STRING)), FALSE
        FROM {customer} {months} WHERE c_custkey % 5 = 0
        UNION ALL
        SELECT c_custkey, 1, make_date(2000 + CAST(floor((10 + i) / 12) AS INT), CAST((10 + i) % 12 + 1 AS INT), 21), -799,
            'Hulu', CASE WHEN i % 2 = 0 THEN 'Hulu' ELSE 'hulu ' END, concat('sub3-', CAST(c_custkey AS STRING), '-', CAST(i AS STRING)), FALSE
        FROM {customer} {months} WHERE c_custkey % 3 = 0
        UNION ALL
        SELECT c_custkey, 1, make_date(2000 + CAST(floor((10 + i) / 12) AS INT), CAST((10 + i) % 12 + 1 AS INT), 22), -1099,
            'Disney Plus', 'Disney Plus', concat('sub4-', CAST(c_custkey AS STRING), '-', CAST(i AS STRING)), FALSE
        FROM {customer} {months} WHERE c_custkey % 6 = 0
        UNION ALL
        SELECT c_custkey, s.acct, DATE '2001-11-05' - CAST(s.back AS INT), s.cents, s.name, s.name,
            concat_ws('-', 'spot', CAST(c_custkey AS STRING), CAST(s.back AS STRING), CAST(s.cents AS STRING)), FALSE
        FROM {customer} JOIN (VALUES {spot_rows}) AS s(step, back, cents, acct, name) ON c_custkey % s.step = 0
    ) AS rows_of_all_sources
"""

_ACCOUNTS_SQL = """
    SELECT c_custkey AS owner_id,
        concat('acct-', CAST(c_custkey AS STRING), '-', CAST(a.acct AS STRING)) AS account_id,
        'First Bank' AS institution, a.name AS name, a.type AS type, 'USD' AS currency
    FROM {customer} JOIN (VALUES (0, 'Everyday Checking', 'checking'), (1, 'Rewards Visa', 'credit card'),
        (2, 'Savings Plus', 'savings')) AS a(acct, name, type) ON a.acct >= 0
"""

_EVENTS_SQL = """
    SELECT user_id AS owner_id, concat('acct-', CAST(user_id AS STRING), '-', CAST(event_id % 2 AS STRING)) AS account_id,
        CAST(ts AS DATE) AS posted_at,
        CAST(CASE WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN round(value * 100) ELSE -round(value * 100) END AS BIGINT) AS amount_cents,
        'USD' AS currency, event_type AS description, event_type AS merchant,
        concat('ev-', CAST(event_id AS STRING)) AS source_txn_id, md5(concat('ev-', CAST(event_id AS STRING))) AS fingerprint,
        FALSE AS pending, ts AS created_at, ts AS updated_at
    FROM {events}
"""

_SPARK_MONTHS = "LATERAL VIEW explode(sequence(0, 11)) month_series AS i"
_CHECK_MONTHS = "CROSS JOIN (SELECT unnest(range(0, 12)) AS i) AS month_series"
_FIXED = {"merchant_rows": _MERCHANT_ROWS, "spot_rows": _SPOT_ROWS}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Customers that one task turns into rows: the views make up to some dozens of each.
CUSTOMERS_A_TASK = 25_000


def spread_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers, dealt to as many tasks as their rows need. A file of one row group is read by one task, which would make and
    pre-aggregate the rows of all of them."""
    customers = read_table(spark, sf_dir, "customer")
    tasks = -(-customers.count() // CUSTOMERS_A_TASK)
    return customers.repartition(tasks, "c_custkey") if tasks > 1 else customers


# Rows of the input tables for which all ledgers are cut into one more slice, and slices' worth of them that are turned into ledger rows at once.
ROWS_A_SLICE = 16_000_000
SLICES_A_PART = 4
# What tells the parts of a table: an order and its line items are in one part.
_PART_KEYS = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}


def share(count: int, *columns: str) -> Column:
    """Number below `count` of the share of the rows that a row belongs to; rows alike in `columns`, nulls too, are in one."""
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in columns]), F.lit(count)).cast("int")


def slice_count(spark: SparkSession, sf_dir: str) -> int:
    """Slices of ledgers that keep the disk a job needs at once in step with a slice, not with all of them."""
    return max(1, -(-sum(read_table(spark, sf_dir, t).count() for t in _PART_KEYS) // ROWS_A_SLICE))


def _spark_view(spark: SparkSession, sf_dir: str, sql: str, part: tuple[int, int] | None = None) -> DataFrame:
    used = {t: read_table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    enough_partitions(*used.values())
    if "customer" in used:
        used["customer"] = spread_customers(spark, sf_dir)
    if part is not None:
        used = {t: rows.filter(share(part[1], _PART_KEYS[t]) == part[0]) for t, rows in used.items()}
    names = {t: "{" + t + "}" for t in TABLES}
    return spark.sql(sql.format(**names, **_FIXED, months=_SPARK_MONTHS), **used)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark_view(spark, sf_dir, _LEDGER_SQL)


def ledger_parts(spark: SparkSession, sf_dir: str) -> Iterator[DataFrame]:
    """The same rows in parts, each of a share of the orders and customers, so that no more than its line items are shuffled at once."""
    parts = -(-slice_count(spark, sf_dir) // SLICES_A_PART)
    for k in range(parts):
        yield _spark_view(spark, sf_dir, _LEDGER_SQL, (k, parts) if parts > 1 else None)


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark_view(spark, sf_dir, _ACCOUNTS_SQL)


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense 30-day ledger over the event stream."""
    return _spark_view(spark, sf_dir, _EVENTS_SQL)


def check_sql(view: str) -> str:
    """Text of a view for the SQL that checks results."""
    text = {"ledger": _LEDGER_SQL, "accounts": _ACCOUNTS_SQL, "event_ledger": _EVENTS_SQL}[view]
    return text.format(**{t: t for t in TABLES}, **_FIXED, months=_CHECK_MONTHS)
