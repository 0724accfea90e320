"""The matchers against a serial search that tries every partner."""

import datetime as dt
import hashlib
import random

import pytest

from tallywork.lexicon import keywords as kw
from tallywork.operators import matching, pairing, refunds
from tallywork.operators.components import components
from tallywork.operators.pairing import transfer_pairs
from tallywork.session import cut_lineage


def md5(value):
    return hashlib.md5(value.encode()).hexdigest()


def random_rows(seed, n=60):
    rng = random.Random(seed)
    names = ["online transfer", "gadget", "zelle", "cafe refund", "cafe", "cafe north", "shop"]
    start = dt.date(2024, 1, 1)
    return [(rng.choice(["chk", "card", "sav"]), start + dt.timedelta(days=rng.randrange(12)),
             rng.choice([-1, 1]) * rng.choice([1000, 1000, 1100, 1250, 5000]), rng.choice(names), rng.choice([1, 1, 2])) for _ in range(n)]


def has_words(merchant):
    return any(w in merchant for w in kw.PAIR_TRANSFER + kw.PAIR_CARD_PAYMENT)


def serial_pairs(rows):
    legs = [dict(fp=f"f{i:05d}", account=a, day=d, cents=abs(c), out=c < 0, worded=has_words(m), owner=o) for i, (a, d, c, m, o) in enumerate(rows)]
    order = lambda g: (g["owner"], g["day"], -g["cents"], g["account"], g["worded"], md5(g["fp"]))
    outs, ins, found = sorted((g for g in legs if g["out"]), key=order), sorted((g for g in legs if not g["out"]), key=order), set()
    taken = set()
    for o in outs:
        best, top = None, 0.0
        for i in ins:
            days, cents = abs((o["day"] - i["day"]).days), abs(o["cents"] - i["cents"])
            if i["fp"] in taken or i["owner"] != o["owner"] or i["account"] == o["account"] or days > 3 or cents > 300:
                continue
            score = (1 - days / 4) * 0.4 + (1 - cents / 301) * 0.6
            score += (0.2 if cents == 0 else 0) + (0.1 if days == 0 else 0)
            score += (0.15 if o["worded"] or i["worded"] else 0) + (0.1 if o["worded"] and i["worded"] else 0)
            if score > top:
                best, top = i, score
        if best and top >= (0.5 if o["worded"] else 0.7):
            taken.add(best["fp"])
            found.add((o["fp"], best["fp"]))
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_serial_search(make_ledger, seed):
    rows = random_rows(seed)
    got = {(r.out_fingerprint, r.in_fingerprint) for r in transfer_pairs(make_ledger(rows)).collect()}
    assert got == serial_pairs(rows)


def test_copies_stay_linear(make_ledger):
    """300 equal legs on each side are one candidate, and all get a partner."""
    rows = [("chk", "2024-01-01", -1000, "transfer")] * 300 + [("sav", "2024-01-02", 1000, "transfer")] * 280
    ledger = make_ledger(rows)
    assert pairing.pair_candidates(ledger).count() == 1
    pairs = transfer_pairs(ledger).collect()
    assert len(pairs) == 280
    assert len({p.out_fingerprint for p in pairs}) == len({p.in_fingerprint for p in pairs}) == 280


def test_pair_limits(make_ledger):
    rows = [("chk", "2024-01-01", -50000, "transfer a"), ("sav", "2024-01-04", 50300, "transfer a"),
            ("chk", "2024-02-01", -60000, "transfer b"), ("sav", "2024-02-05", 60000, "transfer b"),
            ("chk", "2024-03-01", -70000, "transfer c"), ("sav", "2024-03-01", 70301, "transfer c"),
            ("chk", "2024-04-01", -80000, "transfer d"), ("chk", "2024-04-01", 80000, "transfer d")]
    assert transfer_pairs(make_ledger(rows)).count() == 0  # first is in reach but scores below the threshold
    near = [("chk", "2024-01-01", -50000, "transfer a"), ("sav", "2024-01-02", 50000, "transfer a")]
    pair = transfer_pairs(make_ledger(near)).first()
    assert pair.match_reason == "exact amount, 1 day apart" and pair.confidence == 1.0


def serial_refunds(rows):
    def match(a, b):
        words = lambda s: [w for w in s.replace(".", " ").replace("-", " ").replace("_", " ").split() if len(w) > 2]
        return a == b or a in b or b in a or (bool(words(a)) and bool(words(b)) and words(a)[0] == words(b)[0])

    legs = [dict(fp=f"f{i:05d}", day=d, cents=abs(c), credit=c > 0, m=m, owner=o) for i, (_, d, c, m, o) in enumerate(rows)]
    order = lambda g: (g["owner"], -g["day"].toordinal(), g["m"], g["cents"], md5(g["fp"]))
    refs, exps = sorted((g for g in legs if g["credit"]), key=order), sorted((g for g in legs if not g["credit"]), key=order)
    taken, found = set(), set()
    for r in refs:
        worded = any(w in r["m"] for w in kw.MATCH_REFUND)
        best, top = None, 0.0
        for e in exps:
            days = (r["day"] - e["day"]).days
            same = match(r["m"], e["m"])
            if e["fp"] in taken or e["owner"] != r["owner"] or not 0 <= days <= 90 or not (same or worded):
                continue
            if r["cents"] > e["cents"] + int(e["cents"] * 5.0 / 100):
                continue
            off = abs(r["cents"] - e["cents"]) / e["cents"] * 100
            score = (0.4 if same else 0.0) + (0.2 if worded else 0.0)
            score += 0.3 if off < 1 else 0.2 if off < 5 else 0.1 if off < 20 else 0.0
            score += 0.1 if days <= 7 else 0.05 if days <= 30 else 0.0
            if score > top and score >= 0.4:
                best, top = e, score
        if best:
            taken.add(best["fp"])
            found.add((r["fp"], best["fp"]))
    return found


@pytest.mark.parametrize("seed", [3, 4])
def test_refunds_equal_serial_search(make_ledger, seed):
    rows = random_rows(seed)
    got = {(r.refund_fingerprint, r.expense_fingerprint) for r in refunds.refund_matches(make_ledger(rows)).collect()}
    assert got == serial_refunds(rows)


def test_result_does_not_depend_on_partitions(spark, make_ledger):
    ledger = make_ledger(random_rows(5))
    first = sorted(r.pair_id for r in transfer_pairs(ledger).collect())
    assert first == sorted(r.pair_id for r in transfer_pairs(ledger.repartition(7)).collect())


@pytest.mark.parametrize("most", [0, 6])
def test_large_ledgers_match_alike(make_ledger, monkeypatch, most):
    """Ledgers over the limit go by components, components over it in rounds; the pairs stay those of the serial search."""
    monkeypatch.setattr(matching, "SERIAL_MOST", most)
    rows = random_rows(6, 40)
    pairs = {(r.out_fingerprint, r.in_fingerprint) for r in transfer_pairs(make_ledger(rows)).collect()}
    assert pairs == serial_pairs(rows)
    got = {(r.refund_fingerprint, r.expense_fingerprint) for r in refunds.refund_matches(make_ledger(rows)).collect()}
    assert got == serial_refunds(rows)


def test_a_long_chain_takes_few_jobs(spark, make_ledger):
    """2,000 lots of which each is second choice of the next: once 1,000 rounds."""
    rows = []
    for k in range(1000):
        rows += [("chk", "2024-01-01", -(100_000 + 200 * k), "transfer"), ("sav", "2024-01-01", 100_000 + 200 * k + 90, "transfer")]
    ledger = cut_lineage(make_ledger(rows))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    pairs = transfer_pairs(ledger)
    assert len(tracker.getJobIdsForGroup("chain")) < 10
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert pairs.count() == 1000


def test_components(spark):
    rng = random.Random(7)
    edges = [(k, k + 1) for k in range(300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(5, 5), (2000, 2001), (2001, 2000)]
    root = {n: n for e in edges if e[0] != e[1] for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
