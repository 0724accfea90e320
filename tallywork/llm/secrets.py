"""Secrets in texts: candidate strings judged by a random forest, with DataFrame functions alone.

A candidate is a long string with digits, or anything that is assigned to a name like a credential's; a word of minified
JSON or an address with parameters holds several. The forest reads its length, its changes between kinds of characters, how much of it is made of words that the documents use,
whether it looks like a path, and the words around it. It is trained from labelled findings and removes the false positives.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import store
from .common import named

LONG = 16
_CREDENTIAL = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|auth|credential|private.?key|bearer|signature|(?<![a-z])sig(?![a-z]))"
_OTHER = r"(?i)(example|sample|sha\d|md5|commit|hash|digest|checksum|uuid|guid|version|revision|isbn|phone|order|card|iban|build|ref\b)"
_SIGN = r"^(=|:|:=|=>|->)$"
#: What parts the pieces of a word.
_STOPS = r"\s\"'&,;{}()\[\]<>|"
#: A name, a sign and, looked at but not consumed, the value: up to its closing quote, or else up to a stop or the next sign.
_PAIR = rf"(?<![\w.\-])([\w.\-]++)\\?[\"']?(?:[:=]++>?|(?<=-)>)(?!//)(?=\\?(\"[^\"]++\"|'[^']++'|[\"']?[^{_STOPS}=:][^{_STOPS}=]*+={{0,2}}))"
_EDGES = r"^[\\\"'(\[{<=:]+|[\\\"'),.;:\]}>#*&%$!?]+$"
#: A word is in the dictionary if so many documents use it.
KNOWN_FROM = 3
#: Labelled findings that a fit sees at most, and the forest's size.
FIT_ROWS, TREES, DEPTH = 8_000, 32, 8
FEATURES = ["length", "digits", "upper", "lower", "signs", "transitions", "kinds", "different", "hexadecimal", "letter_runs", "covered", "slashes", "dots", "url",
            "named_secret", "named_other", "assigned", "quoted", "near_secret", "near_other", "placeholder"]


def _words(text: Column) -> Column:
    return F.split(F.trim(text), r"\s+")


def _long(value: Column) -> Column:
    """A run of LONG letters, digits and signs, with a digit or several changes to upper case."""
    return (F.length(value) >= LONG) & value.rlike(rf"[A-Za-z0-9+/_=\-]{{{LONG}}}") & value.rlike("[0-9]|[a-z][A-Z].*[a-z][A-Z]")


def _stripped(value: Column) -> Column:
    return F.regexp_replace(value, _EDGES, "")


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, word_no (from 0), word, value, name, before, after, sign: every candidate string with what stands around it.

    A word without white space gives as many candidates as it holds: every value assigned to a credential's name, however
    short, every long value of any name, and every long piece between quotes, brackets, commas and the like. A value
    without quotes ends at the next `=` but for closing ones. `word` is the piece of the word that the value was cut from."""
    d = named(docs, doc_id=doc_id, text=text).filter(F.col("text").isNotNull()).select("doc_id", _words(F.col("text")).alias("w"))
    words = F.col("w")
    at = lambda i: F.coalesce(F.get(words, i), F.lit(""))

    def context(w: Column, i: Column) -> Column:
        last = F.coalesce(F.get(words, i - 1), F.lit(""))
        given = F.right(last, F.lit(1)).isin("=", ":", ">") & (last.rlike(_CREDENTIAL) | (last.rlike(_SIGN) & at(i - 2).rlike(_CREDENTIAL)))
        inline = (w.contains("=") | w.contains(":") | w.contains("->")) & w.rlike(_CREDENTIAL)
        around = F.struct(i.alias("word_no"), w.alias("whole"), last.alias("b1"), at(i - 2).alias("b2"), at(i - 3).alias("b3"), at(i + 1).alias("after"))
        return F.when(_long(w) | inline | given, around)

    # Only the words around a candidate go on, never the whole text with each.
    c = d.select("doc_id", F.explode(F.array_compact(F.transform("w", context))).alias("c")).select("doc_id", "c.*")
    apart = F.col("b1").rlike(_SIGN)
    joined = F.col("b1").rlike(r"[\w\"'](:|=|:=|=>|->)$")
    c = c.select(
        "doc_id", "word_no", "whole", "after", (apart | joined).alias("signed"),
        F.when(apart, F.col("b2")).when(joined, F.regexp_replace("b1", r"[:=>\-]+$", "")).otherwise("").alias("given"),
        F.when(apart, F.col("b3")).when(joined, F.col("b2")).otherwise(F.col("b1")).alias("before"),
        F.regexp_extract_all("whole", F.lit(_PAIR), F.lit(1)).alias("names"), F.regexp_extract_all("whole", F.lit(_PAIR), F.lit(2)).alias("values"),
    )
    one = lambda word, value, name, sign: F.struct(word.alias("word"), value.alias("value"), name.alias("name"), sign.alias("sign"))
    pairs = F.zip_with("names", "values", lambda n, v: one(v, _stripped(v), n, F.lit(True)))
    c = c.withColumn("pairs", F.filter(pairs, lambda p: p["name"].rlike(_CREDENTIAL) | _long(p["value"])))
    whole = _stripped(F.col("whole"))
    named_so = F.when(F.col("signed") & F.col("given").rlike(_CREDENTIAL), F.array(one(F.col("whole"), whole, F.col("given"), F.lit(True))))
    ends = lambda piece, value: (piece == value) | piece.endswith(F.concat(F.lit("="), value)) | piece.endswith(F.concat(F.lit(":"), value)) | piece.endswith(F.concat(F.lit(">"), value))
    pieces = F.filter(F.split("whole", f"[{_STOPS}]+"), lambda x: _long(x) & ~F.exists("pairs", lambda p: ends(x, p["value"])))
    pieces = F.transform(pieces, lambda x: one(x, _stripped(x), F.col("given"), F.col("signed")))
    c = c.withColumn("own", F.coalesce(named_so, F.slice("pairs", 1, 0))).withColumn("pieces", pieces)
    pieces = F.filter("pieces", lambda x: ~F.exists("own", lambda o: o["value"] == x["value"]))
    found = F.array_distinct(F.filter(F.concat("own", "pairs", pieces), lambda x: x["value"] != ""))
    return c.select("doc_id", "word_no", "before", "after", F.explode(found).alias("f")).select("doc_id", "word_no", "f.*", "before", "after")


def known_words(docs: DataFrame, runs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """run: those of `runs`(run) that at least KNOWN_FROM documents use as a word. Counts cover all documents."""
    d = named(docs, text=text)
    used = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: F.length(w) >= 3))
    counts = d.select(F.explode(used).alias("word")).groupBy("word").count().filter(F.col("count") >= KNOWN_FROM)
    return runs.select("run").distinct().join(counts, F.col("run") == F.col("word"), "left_semi")


def letter_runs(found: DataFrame) -> DataFrame:
    """key, run: the letter runs of three or more in a value, parted at changes from lower to upper case."""
    parted = F.lower(F.regexp_replace("value", "(?<=[a-z])(?=[A-Z])", " "))
    return found.select("key", F.explode(F.regexp_extract_all(parted, F.lit("[a-z]{3,}"), F.lit(0))).alias("run"))


def _share(value: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{kept}]", "")) / F.greatest(F.length(value), F.lit(1))


def dictionary(docs: DataFrame, *found: DataFrame, text: str = "text") -> DataFrame:
    """known: the letter runs of all `found` that the documents use, stored after one reading of the documents."""
    runs = letter_runs(found[0]).select("run").distinct()
    for more in found[1:]:
        runs = runs.union(letter_runs(more).select("run").distinct())
    return store(known_words(docs, runs, text=text).withColumnRenamed("run", "known"))


def described(found: DataFrame, known: DataFrame) -> DataFrame:
    """`found` with the FEATURES; found(key, word, value, name, before, after, sign), `known` as of dictionary."""
    runs = letter_runs(found.dropDuplicates(["key"]))
    covered = runs.join(known, runs["run"] == known["known"]).groupBy("key").agg(F.sum(F.length("run")).alias("covered_chars"))
    v = F.col("value")
    n = F.greatest(F.length(v), F.lit(1))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "-")
    one_each = F.regexp_replace(classes, r"(.)\1+", "$1")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    rows = found.join(covered.withColumnRenamed("key", "of"), F.col("key") == F.col("of"), "left").drop("of")
    return rows.select(
        *found.columns, F.log1p(F.length(v)).alias("length"), _share(v, "0-9").alias("digits"), _share(v, "A-Z").alias("upper"), _share(v, "a-z").alias("lower"),
        (1 - _share(v, "A-Za-z0-9")).alias("signs"),
        (F.length(one_each) / n).alias("transitions"), F.size(F.array_distinct(F.split(classes, ""))).cast("double").alias("kinds"),
        (F.size(F.array_distinct(F.split(v, ""))) / n).alias("different"), flag(v.rlike("^([0-9a-f]{16,}|[0-9A-F]{16,})$")).alias("hexadecimal"),
        F.size(F.regexp_extract_all(v, F.lit("[A-Za-z]{3,}"), F.lit(0))).cast("double").alias("letter_runs"),
        (F.coalesce("covered_chars", F.lit(0)) / n).alias("covered"), (F.length(v) - F.length(F.replace(v, F.lit("/"), F.lit("")))).cast("double").alias("slashes"),
        (F.length(v) - F.length(F.replace(v, F.lit("."), F.lit("")))).cast("double").alias("dots"), flag(F.col("word").rlike("://|@|^www")).alias("url"),
        flag(F.col("name").rlike(_CREDENTIAL)).alias("named_secret"), flag(F.col("name").rlike(_OTHER)).alias("named_other"), flag(F.col("sign")).alias("assigned"),
        flag(F.col("word").rlike("[\"']")).alias("quoted"), flag(F.concat_ws(" ", "before", "after").rlike(_CREDENTIAL)).alias("near_secret"),
        flag(F.concat_ws(" ", "before", "after").rlike(_OTHER)).alias("near_other"), flag(v.rlike(r"(?i)example|your|placeholder|changeme|xxxx|1234567|(.)\1{5,}")).alias("placeholder"),
    )


def made_findings(docs: DataFrame, rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Labelled findings made out of at most `rows` documents: key, word, value, name, before, after, sign, label.

    Values and the words around them come from the documents; what kind of finding a row is follows from a hash of the
    row. Secrets are digests and mixed strings given a credential's name, or with a well-known prefix, and words with digits
    given as a password. The others are digests given as such, numbers, identifiers made of the text's words, plain words
    after a credential's name, addresses, and placeholders. Words are among the first twelve of a text: these are
    training rows, bounded like their number; candidates are sought in whole texts."""
    d = named(docs, doc_id=doc_id, text=text).filter(F.length("text") > 0).withColumn("order", F.xxhash64("doc_id", "text"))
    # Only hashes are sorted, never texts: documents up to the last of the `rows` least hashes are taken.
    last = d.select("order").distinct().orderBy("order").limit(rows).agg(F.max("order")).first()[0]
    d = d.filter(F.col("order") <= F.lit(last)).dropDuplicates(["order"])
    d = d.select(F.xxhash64("doc_id", "text", F.lit(1)).alias("key"), "text", F.sha2("text", 256).alias("hex"))
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) > 2)
    d = d.withColumn("ws", F.slice(words, 1, 12)).withColumn("kind", F.pmod("key", F.lit(14)))
    word = lambda k: F.coalesce(F.get("ws", F.lit(k)), F.lit("of"))
    pick = lambda items, salt: F.get(F.array(*map(F.lit, items)), F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(len(items))).cast("int"))
    base64 = F.base64(F.unhex("hex"))
    mixed = F.regexp_replace(base64, "[+/=]", "")
    size = F.lit(20) + F.pmod(F.xxhash64("key", F.lit(5)), F.lit(20)).cast("int")
    value = (
        F.when(F.col("kind").isin(0, 10), F.substr("hex", F.lit(1), F.lit(40))).when(F.col("kind") == 1, F.substr(base64, F.lit(1), size))
        .when(F.col("kind") == 2, F.concat(pick(["AKIA", "ghp_", "sk_live_", "xoxb-"], 2), F.substr(mixed, F.lit(1), F.lit(24))))
        .when(F.col("kind") == 3, F.substr(mixed, F.lit(3), size)).when(F.col("kind") == 4, F.substr("hex", F.lit(1), pick([32, 40, 64], 4)))
        .when(F.col("kind").isin(5, 11), F.substr(F.regexp_replace(F.concat(F.conv(F.substr("hex", F.lit(1), F.lit(15)), 16, 10), F.lit("4929")), "^0", "4"), F.lit(1), F.lit(16)))
        .when(F.col("kind") == 6, F.concat(word(0), F.lit("_"), word(1), F.lit("_"), word(2), pick(["", "2", "_v10"], 3)))
        .when(F.col("kind") == 7, F.concat(F.lit("https://"), word(0), F.lit(".example.com/"), word(1), F.lit("/"), word(2), F.lit("-1024.html")))
        .when(F.col("kind") == 8, F.regexp_replace(F.substr("hex", F.lit(1), F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
        .when(F.col("kind") == 12, F.concat(word(0), F.pmod(F.xxhash64("key", F.lit(13)), F.lit(1000)).cast("string"))).when(F.col("kind") == 13, word(0))
        .otherwise(pick(["your_api_key_here_123", "xxxxxxxxxxxxxxxxxxxx1", "EXAMPLE0KEY0EXAMPLE0", "changeme1234567890", "1234567890123456789"], 6))
    )
    secret_name = pick(["token", "secret", "api_key", "password", "access_key", "auth_token", "client_secret"], 7)
    name = (
        F.when(F.col("kind").isin(0, 1, 3, 9), secret_name).when(F.col("kind") == 4, pick(["commit", "sha1", "checksum", "digest", "", ""], 8))
        .when(F.col("kind") == 6, pick(["token", "name", "", "password"], 9)).when(F.col("kind") == 8, pick(["id", "uuid", "", "ref"], 10))
        .when(F.col("kind").isin(10, 13), secret_name).when(F.col("kind") == 12, pick(["password", "pwd", "secret", "passwd"], 14)).otherwise(pick(["", "", "key"], 11))
    )
    out = d.select("key", value.alias("value"), name.alias("name"), word(4).alias("before"), word(5).alias("after"), F.col("kind").isin(0, 1, 2, 3, 10, 12).cast("double").alias("label"))
    quote = F.when(F.pmod(F.xxhash64("key", F.lit(12)), F.lit(3)) > 0, F.lit('"')).otherwise(F.lit(""))
    return out.withColumn("sign", F.col("name") != "").withColumn("word", F.when(F.col("sign"), F.concat(quote, "value", quote)).otherwise(F.col("value")))


def fit(findings: DataFrame, known: DataFrame, trees: int = TREES, depth: int = DEPTH) -> PipelineModel:
    """A forest from labelled findings (columns as of made_findings) and the words in use (as of dictionary)."""
    rows = store(described(findings, known).select(*FEATURES, "label"))
    gather = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest: RandomForestClassificationModel = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, maxBins=48).fit(gather.transform(rows))
    return PipelineModel([gather, forest])


def find_secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, word_no, value, name, before, after, score, is_secret: every candidate of whole texts with its verdict.

    `findings` are labelled findings; where none are given they are made from the documents. Null and empty texts have no
    candidates; a candidate that repeats is reported at each place; an empty table gives no rows."""
    found = store(candidates(docs, doc_id, text).withColumn("key", F.xxhash64("doc_id", "word_no", "value")))
    if found.isEmpty():
        return found.select("doc_id", "word_no", "value", "name", "before", "after", F.lit(0.0).alias("score"), F.lit(False).alias("is_secret"))
    plain = named(docs, doc_id=doc_id, text=text)
    labelled = store(made_findings(plain)) if findings is None else findings
    known = dictionary(plain, found, labelled)
    scored = fit(labelled, known).transform(described(found, known)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "word_no", "value", "name", "before", "after", "score", (F.col("score") >= threshold).alias("is_secret"))
