"""Removal of passages that repeat across documents, by content-defined chunks of lines, with DataFrame functions alone.

A rolling hash over the hashes of two lines decides where a chunk ends, so the same lines are cut alike wherever they
stand; a line of many words is a chunk of its own. Chunks that occur again anchor a run of lines that occur again; two
lines that repeat together anchor the runs that no chunk does. In such runs the same lines in the same order, with more
than `over_words` words, are a passage, and its second and later occurrences go. A line that repeats alone stays.
Lines are told to be equal by their bytes, not only by their hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .common import named

#: A chunk ends after a line where the rolling hash leaves no remainder, on average at every second line.
CUT_EVERY = 2
#: A line of so many words is a chunk of its own: of three lines with over 50 words one has at least 17.
OWN_CHUNK_WORDS = 16


def _words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, r"\s+"), lambda w: w != ""))


def line_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), i (line number from 0), h (hash of the line), words, chunk (its number), line. A null text has no lines."""
    d = named(docs, doc_id=doc_id, text=text).filter(F.col("text").isNotNull())
    # The lines are parted and the text hashed before they are dealt out, so that no line carries its whole text.
    d = d.select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n", -1).alias("all"))
    d = d.select("doc_id", "th", F.posexplode("all").alias("i", "line"))
    d = d.withColumn("h", F.xxhash64("line")).withColumn("words", _words(F.col("line")))
    return d


def repeated_lines(docs: DataFrame, over_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, th, drop (sorted numbers of the lines to delete): documents with something to delete, told by id and text.

    Rows equal in id and text are one document. The first occurrence (least id, null ids last, then text hash, then
    line) of a passage stays; a later one that overlaps it loses what lies behind it."""
    lines = line_rows(docs, doc_id, text)
    whole = Window.partitionBy("doc_id", "th").orderBy("i")
    rolling = F.xxhash64(F.lag("h").over(whole), F.col("h"))
    alone = F.col("words") >= OWN_CHUNK_WORDS
    ends = (F.pmod(rolling, F.lit(CUT_EVERY)) == 0) | alone | F.coalesce(F.lead("words").over(whole) >= OWN_CHUNK_WORDS, F.lit(False))
    narrow = lines.drop("line").distinct().withColumn("ends", ends)
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    narrow = narrow.withColumn("chunk", F.coalesce(F.sum(F.col("ends").cast("int")).over(before), F.lit(0)))
    narrow = store(narrow.select("doc_id", "th", "i", "h", "words", "chunk"))

    again = narrow.groupBy(F.col("h").alias("rh")).agg(F.count("*").alias("times")).filter("times > 1")
    texts = lines.groupBy("h", "line").agg(F.count("*").alias("rows")).groupBy(F.col("h").alias("ch")).agg(F.count("*").alias("texts"))
    clash = texts.filter("texts > 1")  # unequal lines of one hash are left alone
    again = store(again.join(clash, again["rh"] == clash["ch"], "left_anti"))

    chunk = narrow.groupBy("doc_id", "th", "chunk").agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("lines"))
    chunk = store(chunk.select("doc_id", "th", "chunk", F.xxhash64(F.transform("lines", lambda x: x["h"]), F.size("lines")).alias("key")))
    anchors = store(chunk.groupBy(F.col("key").alias("akey")).count().filter("count > 1"))  # stored, so that the join can split a hot chunk
    anchored = chunk.join(anchors, chunk["key"] == anchors["akey"], "left_semi").select(
        F.col("doc_id").alias("a_id"), F.col("th").alias("a_th"), F.col("chunk").alias("a_chunk")
    )

    marked = narrow.filter("words > 0").join(again, narrow["h"] == again["rh"], "left").select(narrow["*"], F.col("rh").isNotNull().alias("again"))
    # Empty lines are no lines of a passage; how many stand before a line is part of what it is.
    marked = marked.withColumn("p", F.row_number().over(whole)).withColumn("gap", F.col("i") - F.coalesce(F.lag("i").over(whole), F.lit(-1))).filter("again")
    same = marked["doc_id"].eqNullSafe(anchored["a_id"]) & (marked["th"] == anchored["a_th"]) & (marked["chunk"] == anchored["a_chunk"])
    marked = marked.join(anchored, same, "left").select(marked["*"], F.col("a_th").isNotNull().alias("anchor"))
    run = Window.partitionBy("doc_id", "th", "run")
    marked = marked.withColumn("run", F.col("p") - F.row_number().over(whole))
    long = marked.withColumn("run_words", F.sum("words").over(run)).withColumn("anchored", F.max("anchor").over(run)).filter(F.col("run_words") > over_words)
    after = run.orderBy("i")
    seam = F.when(F.lead("h").over(after).isNotNull(), F.xxhash64("h", F.lead("h").over(after), F.lead("gap").over(after)))
    long = store(long.select("doc_id", "th", "i", "h", "words", "gap", "run", "anchored", seam.alias("seam")))

    # Runs without a repeated chunk count if a line and its next one repeat together.
    seams = store(long.filter("seam is not null").groupBy(F.col("seam").alias("again_seam")).agg(F.count("*").alias("times")).filter("times > 1"))
    rest = long.filter("not anchored")
    sewn = rest.join(seams, rest["seam"] == seams["again_seam"], "left_semi").select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"), F.col("run").alias("s_run")).distinct()
    sewn = rest.join(sewn, rest["doc_id"].eqNullSafe(sewn["s_id"]) & (rest["th"] == sewn["s_th"]) & (rest["run"] == sewn["s_run"]), "left_semi")
    passages = store(_passages(long.filter("anchored").union(sewn), over_words))

    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("th").alias("th"), F.col("a").alias("a"), F.col("b").alias("b"))
    firsts = passages.groupBy(F.col("k1").alias("f1"), F.col("k2").alias("f2")).agg(F.count("*").alias("times"), F.min(place).alias("first")).filter("times > 1")
    firsts = store(firsts.select("f1", "f2", "first"))  # stored, so that the join can split a hot passage
    found = passages.join(firsts, (passages["k1"] == firsts["f1"]) & (passages["k2"] == firsts["f2"])).filter(place != F.col("first"))
    at_home = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    found = found.withColumn("start", F.when(at_home, F.greatest(F.col("a"), F.col("first.b") + 1)).otherwise(F.col("a"))).filter("start <= b")
    return found.groupBy("doc_id", "th").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", "b"))))).alias("drop"))


def _passages(rows: DataFrame, over_words: int) -> DataFrame:
    """doc_id, th, a, b (first and last line), k1, k2 (hashes of the lines in order): the shortest passages of over `over_words`
    words that start or end at each line of rows(doc_id, th, run, i, h, words, gap).

    Every passage of more words is made up of such ones. A line has a word or more, so none has over `over_words` + 1 lines."""
    order = Window.partitionBy("doc_id", "th", "run").orderBy("i")
    line = F.struct("i", "h", "words", "gap")
    both = rows.withColumn("ahead", F.collect_list(line).over(order.rowsBetween(0, over_words))).withColumn("behind", F.collect_list(line).over(order.rowsBetween(-over_words, 0)))
    start = F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).alias("n"))

    def needed(lines: Column) -> Column:
        """How many of the lines have over `over_words` words; null if all have not."""
        step = lambda acc, x: F.when(acc["w"] > over_words, acc).otherwise(F.struct((acc["w"] + x["words"]).alias("w"), (acc["n"] + 1).alias("n")))
        return F.aggregate(lines, start, step, lambda acc: F.when(acc["w"] > over_words, acc["n"]))

    both = both.withColumn("n_ahead", needed(F.col("ahead"))).withColumn("n_behind", needed(F.reverse("behind")))
    ahead = F.when(F.col("n_ahead").isNotNull(), F.slice("ahead", F.lit(1), F.col("n_ahead")))
    behind = F.when(F.col("n_behind").isNotNull(), F.slice("behind", -F.col("n_behind"), F.col("n_behind")))
    made = both.select("doc_id", "th", F.explode(F.array_compact(F.array(ahead, behind))).alias("ls"))
    content = F.transform("ls", lambda x, k: F.when(k == 0, x["h"]).otherwise(F.xxhash64(x["h"], x["gap"])))
    made = made.select("doc_id", "th", F.get("ls", F.lit(0))["i"].alias("a"), F.element_at("ls", -1)["i"].alias("b"), content.alias("content"))
    return made.select("doc_id", "th", "a", "b", F.xxhash64("content").alias("k1"), F.xxhash64(F.lit(1), "content").alias("k2")).distinct()


def _at(items: Column, places: Column) -> Column:
    """The items at sorted places. Both arrays are arguments of one function, so each is made once a row, not once an item."""
    held = F.array(F.named_struct(F.lit("items"), items, F.lit("places"), places))
    return F.flatten(F.transform(held, lambda x: F.transform(x["places"], lambda i: F.get(x["items"], i))))


def without_repeats(docs: DataFrame, over_words: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` with the kept lines as text, and two more columns: lines_before, lines_dropped.

    No row is dropped: a document all of whose lines occur earlier is left with an empty text. A null text stays null with
    0 lines, an empty text is one empty line. An empty table gives no rows. Columns of the caller pass through, but for
    those named lines_before or lines_dropped, which are replaced."""
    drops = repeated_lines(docs, over_words, doc_id, text).select(F.col("doc_id").alias("_drop_id"), F.col("th").alias("_drop_th"), F.col("drop").alias("_drop"))
    joined = docs.join(drops, docs[doc_id].eqNullSafe(drops["_drop_id"]) & (F.xxhash64(docs[text]) == drops["_drop_th"]), "left")
    lines = F.split(docs[text], "\n", -1)
    # Numbers of the lines that stay, as a difference of sets; the fold walks them and the lines side by side.
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops["_drop"])
    kept = F.when(F.size(stay) > 0, F.array_join(_at(lines, stay), "\n")).otherwise("")
    new = F.when(drops["_drop"].isNull(), docs[text]).otherwise(kept).alias(text)
    made = ("lines_before", "lines_dropped")
    return joined.select(
        *[new if c == text else docs[c] for c in docs.columns if c not in made],
        F.when(docs[text].isNull(), 0).otherwise(F.size(lines)).alias("lines_before"), F.coalesce(F.size(drops["_drop"]), F.lit(0)).alias("lines_dropped"),
    )
