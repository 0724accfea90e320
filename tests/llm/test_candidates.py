"""Candidate strings: every assigned value and every long piece of a word, each with its own name."""

from tallywork.llm import secrets

LONG_KEY = "Zk93jfLq02mXa81QwE7"


def pairs(spark, text):
    return {(r.name, r.value) for r in secrets.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}


def test_each_pair_of_minified_json_is_a_candidate(spark):
    got = pairs(spark, f'see {{"user":"bob","password":"hunter2-abc","api_key":"{LONG_KEY}","size":12}} end')
    assert got == {("password", "hunter2-abc"), ("api_key", LONG_KEY)}
    got = pairs(spark, f'{{\\"token\\":\\"a;b&c\\",\\"blob\\":[\\"{LONG_KEY}\\"]}}')
    assert got == {("token", "a;b&c"), ("", LONG_KEY)}


def test_parameters_of_an_address(spark):
    got = pairs(spark, f"https://host.example/path?token=abc12&page=3&sig={LONG_KEY}==&x=1")
    assert got == {("token", "abc12"), ("sig", LONG_KEY + "==")}


def test_short_values_and_signs_apart(spark):
    assert pairs(spark, "password=hunter2") == {("password", "hunter2")}
    assert pairs(spark, "pwd:abc123, then") == {("pwd", "abc123")}
    assert pairs(spark, "the password: hunter2. done") == {("password", "hunter2")}
    assert pairs(spark, "--auth-token -> 'x1' and secret := y2") == {("--auth-token", "x1"), ("secret", "y2")}
    assert pairs(spark, "config=token=abc and a->pwd->q9") == {("token", "abc"), ("pwd-", "q9")}
    assert pairs(spark, f"commit={LONG_KEY}") == {("commit", LONG_KEY)}
    assert pairs(spark, "") == pairs(spark, "password: ") == pairs(spark, "== :: -> '' at 12:30:45 on https://a.example/b") == set()


def test_a_very_long_word(spark):
    text = ",".join(f'"pwd{k}":"v{k}"' for k in range(20_000)) + "=" * 50_000 + "a=" * 20_000 + "x-" * 20_000
    got = pairs(spark, text)
    assert {(f"pwd{k}", f"v{k}") for k in range(20_000)} <= got


def test_places_repeats_and_rows_without_an_id(spark, hard_docs, hard_rows):
    docs = spark.createDataFrame([(None, "pwd=a1 x pwd=a1"), (None, "pwd=a1 x pwd=a1"), (2, None)], "doc_id long, text string")
    rows = secrets.candidates(docs).collect()
    assert sorted((r.doc_id is None, r.word_no, r.value) for r in rows) == [(True, 0, "a1")] * 2 + [(True, 2, "a1")] * 2
    got = secrets.find_secrets(docs)
    assert got.count() == 4 and "Python" not in got._jdf.queryExecution().toString()
