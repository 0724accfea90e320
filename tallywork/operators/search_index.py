"""Text search over a ledger by stored trigrams.

Different texts (merchant and description) are few beside the rows. They are stored once for all ledgers with a number, each
of their trigrams is posted with that number, and the rows are stored in folders by the number. A search reads the folders of
its own trigrams, keeps texts that have them all, verifies those, and reads only the folders of rows they lie in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .containment import pieces

GRAM = 3
#: Folders of postings and of rows.
GRAM_FOLDERS, ROW_FOLDERS = 64, 256


def _folded(name: str) -> Column:
    return F.lower(F.coalesce(name, F.lit("")))


def _grams(value: Column) -> Column:
    return F.coalesce(pieces(value, GRAM), F.array().cast("array<string>"))


def _folder(value: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(folders)).cast("int")


def build(ledger: DataFrame, path: str) -> None:
    """Writes rows, texts and postings under `path`; columns keep their names, text_no and row_folder are added.

    Each task writes its rows into the folders of their texts, so rows are not shuffled, however many share a text."""
    number = F.xxhash64(_folded("merchant"), _folded("description"))
    rows = ledger.withColumn("text_no", number).withColumn("row_folder", _folder(F.col("text_no"), ROW_FOLDERS))
    rows.write.mode("overwrite").partitionBy("row_folder").parquet(f"{path}/rows")
    stored = ledger.sparkSession.read.parquet(f"{path}/rows")
    texts = stored.select("text_no", _folded("merchant").alias("merchant"), _folded("description").alias("description")).distinct()
    texts.write.mode("overwrite").parquet(f"{path}/texts")
    grams = F.array_distinct(F.concat(_grams(F.col("merchant")), _grams(F.col("description"))))
    posted = ledger.sparkSession.read.parquet(f"{path}/texts").select("text_no", F.explode(grams).alias("gram"))
    posted = posted.withColumn("gram_folder", _folder(F.col("gram"), GRAM_FOLDERS))
    posted.repartition("gram_folder").sortWithinPartitions("gram").write.mode("overwrite").partitionBy("gram_folder").parquet(f"{path}/postings")


def texts_holding(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """text_no of the texts of which merchant or description contains the needle. One shorter than a trigram is looked for in all texts."""
    word = needle.lower()
    texts = spark.read.parquet(f"{path}/texts")
    grams = sorted({word[k : k + GRAM] for k in range(len(word) - GRAM + 1)})
    if grams:
        folders = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_folder(F.col("gram"), GRAM_FOLDERS)).distinct().collect()]
        posted = spark.read.parquet(f"{path}/postings").filter(F.col("gram_folder").isin(folders) & F.col("gram").isin(grams))
        likely = posted.groupBy("text_no").count().filter(F.col("count") == len(grams)).select("text_no")
        texts = texts.join(likely, "text_no", "left_semi")
    return texts.filter(F.contains("merchant", F.lit(word)) | F.contains("description", F.lit(word))).select("text_no").distinct()


def rows_holding(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """Ledger rows with the needle in merchant or description; folders without such a row are not read."""
    found = texts_holding(spark, path, needle)
    folders = [r[0] for r in found.select(_folder(F.col("text_no"), ROW_FOLDERS)).distinct().collect()]  # ROW_FOLDERS numbers at most
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("row_folder").isin(folders))
    return rows.join(found, "text_no", "left_semi").drop("text_no", "row_folder")
