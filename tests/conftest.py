import datetime as dt

import pytest

from tallywork.session import local_session

LEDGER_SCHEMA = ("owner_id long, account_id string, posted_at date, amount_cents long, currency string, description string, "
                 "merchant string, source_txn_id string, fingerprint string, pending boolean, created_at timestamp, updated_at timestamp")
ACCOUNT_SCHEMA = "owner_id long, account_id string, institution string, name string, type string, currency string"


@pytest.fixture(scope="session")
def spark():
    return local_session("4", shuffle_partitions=3, app="tests")


@pytest.fixture(scope="session")
def make_ledger(spark):
    """Ledger from (account, day, cents, merchant[, owner]) rows; fingerprints number the rows."""
    def build(rows, pending=()):
        out = []
        for i, (account, day, cents, merchant, *owner) in enumerate(rows):
            day = dt.date.fromisoformat(day) if isinstance(day, str) else day
            stamp = dt.datetime.combine(day, dt.time(1))
            out.append((owner[0] if owner else 1, account, day, cents, "USD", merchant, merchant, f"s{i}", f"f{i:05d}", i in pending, stamp, stamp))
        return spark.createDataFrame(out, LEDGER_SCHEMA)

    return build


@pytest.fixture(scope="session")
def accounts(spark):
    rows = [(1, "chk", "First", "Everyday Checking", "checking", "USD"), (1, "card", "First", "Rewards Visa", "credit card", "USD"),
            (1, "sav", "First", "Savings Plus", "savings", "USD")]
    return spark.createDataFrame(rows, ACCOUNT_SCHEMA)
