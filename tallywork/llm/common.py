"""Helpers that several of the operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator reads, under its own names, so that columns of the caller never clash with it."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model may learn from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, y of at most `most` learnable rows, spread by a hash of the id; the bound makes the ids safe to broadcast."""
    ids = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
        .filter(~held_out(F.col("id")) & F.col("y").isin(0, 1))
        .groupBy("id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(most)
    )
    d = docs.select(F.col("doc_id"), F.col("text"))
    return d.join(F.broadcast(ids), d["doc_id"] == ids["id"]).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y")


def whole_runs(batches: Iterable[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Batches sorted by `key`, joined to tables of about `rows` rows that never part two rows of one key."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        t = pa.Table.from_batches(held)
        k = t[key].to_numpy()
        cut = int(np.searchsorted(k, k[-1], side="left"))
        if cut:
            yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
            count = t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def numbered(df: DataFrame, name: str, *by: Column, parts: int | None = None) -> DataFrame:
    """The rows, stored in the order of `by` after one range exchange, with their place in that order (from 0) as `name`.

    `by` should tell all rows apart: equal ones cannot be dealt to two tasks. Only a row count of each task meets in one place."""
    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    # Within a task the id counts rows from 0; its upper bits are the task's number, which follows the order.
    placed = store(dealt.sortWithinPartitions(*by).withColumn("at_", F.monotonically_increasing_id()))
    task = F.shiftright("at_", 33)
    before = Window.orderBy("task_").rowsBetween(Window.unboundedPreceding, -1)
    tasks = placed.groupBy(task.alias("task_")).count().select("task_", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before_"))
    return placed.join(F.broadcast(tasks), task == tasks["task_"]).select(  # one row a task
        *df.columns, (F.col("before_") + F.col("at_").bitwiseAND((1 << 33) - 1)).alias(name)
    )
