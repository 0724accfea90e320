"""Quality, toxicity and secrets: learnt models on labelled rows, held-out accuracy, odd rows."""

import pathlib
import zlib

import numpy as np
import pytest

from tallywork.llm import boosting, quality, secrets, toxicity
from tallywork.llm.common import labelled_sample

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    return read("documents"), read("labels")


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_boosting_learns_and_is_flat():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < 0)).astype(float)
    f = boosting.fit(x[:2000], y[:2000])
    assert ((f.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    assert f.feature.ndim == 1 and len(f.feature) == len(f.left) == len(f.value)
    assert boosting.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert (boosting.fit(x[:9], np.ones(9)).score(x) > 0.5).all()


@needs_tables
def test_quality_held_out(tables):
    docs, labels = tables
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    truth = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if held(r.doc_id)]
    assert np.mean([a == b for a, b in truth]) > 0.95


@needs_tables
def test_toxicity_held_out_and_inserted_characters(tables):
    docs, labels = tables
    machine = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, machine).collect()}
    truth = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if held(r.doc_id)]
    assert np.mean([a == b for a, b in truth]) > 0.93
    assert np.mean([b == 0 for a, b in truth if a == 0]) > 0.97
    insult, gapped, harmless = machine.words(["idiot", "idiiot", "thion"])
    assert insult > gapped > harmless


@needs_tables
def test_labels_of_held_out_rows_are_never_read(tables):
    docs, labels = tables
    sample = labelled_sample(docs, labels, "toxic", 100_000).collect()
    assert sample and not any(held(r.doc_id) for r in sample)
    assert labelled_sample(docs, labels, "toxic", 17).count() == 17


@needs_tables
def test_odd_rows_are_scored(tables, hard_docs, hard_rows, no_docs):
    docs, labels = tables
    for module in (quality, toxicity):
        model = module.fit(docs, labels, rows=60)
        assert module.score(hard_docs, model).filter("score between 0 and 1").count() == len(hard_rows)
        assert module.score(no_docs, model).count() == 0
    assert toxicity.without_toxic(hard_docs, model).columns == hard_docs.columns
    kept = toxicity.without_toxic(docs, model).count()
    assert kept == toxicity.score(docs, model).filter("score < 0.7").count()


def test_fit_without_labels_scores_alike(spark, hard_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        assert module.score(hard_docs, module.fit(hard_docs, none)).select("score").distinct().count() == 1


def test_letters_written_apart_are_joined():
    assert "idiot" in toxicity.pieces("you I D I O T there") and "stupid" in toxicity.pieces("s.t.u.p.i.d")
    k = toxicity.kernel(["idiot", "idi-ot".replace("-", ""), "idxiot", "zzzz"], ["idiot"])[:, 0]
    assert k[0] == pytest.approx(1) and 0.3 < k[2] < 1 and k[3] == 0


def test_secrets_are_told_from_numbers(hard_docs, no_docs):
    got = {(r.doc_id, r.value): r for r in secrets.find_secrets(hard_docs).collect()}
    assert got[15, "04dbebab91ab85687d33eeaaf9ac699e1188f962"].is_secret
    assert not got[15, "9807915762804490"].is_secret
    assert got[15, "04dbebab91ab85687d33eeaaf9ac699e1188f962"].name == "token"
    assert secrets.find_secrets(no_docs).count() == 0


@needs_tables
def test_secrets_forest_on_findings_it_has_not_seen(tables):
    docs, _ = tables
    made = secrets.made_findings(docs, 1000)
    known = secrets.dictionary(docs, made)
    model = secrets.fit(made.filter("pmod(key, 5) > 0"), known)
    test = model.transform(secrets.described(made.filter("pmod(key, 5) = 0"), known))
    rows = test.select("label", "prediction").collect()
    assert len(rows) > 100 and np.mean([r.label == r.prediction for r in rows]) > 0.97
