"""Replace, upsert and guarded updates as new versions of a table: plain DataFrames in, the next version out.

write_version() stores a version beside the old one, so that no plan reads what it overwrites.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of a task, about, where rows are dealt by key.
TASK_ROWS = 200_000


def tasks_for(rows: DataFrame) -> int:
    """The number of tasks for rows, which should be cheap to count: it grows with them, and every core has one."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def dealt(rows: DataFrame, tasks: int, keys: list[str]) -> DataFrame:
    """rows in so many tasks by key. What is grouped or joined by these keys afterwards isn't moved again, and no task
    grows: without it a task first groups a whole split of a file, or what Spark puts together by its compressed size."""
    return rows.repartition(tasks, *keys)


def replaced(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of every key that occurs in new give way to the new ones."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upserted(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)


def inserted_if_absent(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(new.join(table.select(*keys).distinct(), keys, "left_anti"))


def updated(table: DataFrame, condition: Column, **columns: Column) -> DataFrame:
    """The columns take their new values where the condition holds (not where it is null)."""
    sure = F.coalesce(condition, F.lit(False))
    return table.withColumns({name: F.when(sure, value).otherwise(F.col(name)) for name, value in columns.items()})


def deleted(table: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return table.join(keys.select(on).distinct() if isinstance(on, str) else keys.select(*on).distinct(), on, "left_anti")


def auto_bound(speakers: DataFrame, contacts: DataFrame, samples: DataFrame, least_score: float, least_samples: int = 2) -> DataFrame:
    """speakers with contact_id and confirmed set where a suggestion is sure: unbound, unconfirmed, a score of at least
    least_score, and a contact who isn't the owner, consents and has enough samples."""
    enough = samples.groupBy(F.col("contact_id").alias("c")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_samples)
    able = contacts.where("NOT is_owner AND consents").select(F.col("contact_id").alias("c")).join(enough, "c").select("c", F.lit(True).alias("able"))
    # Only rows that may be bound are joined: the others share a null suggestion and would meet in one task.
    may = F.coalesce(F.col("contact_id").isNull() & ~F.col("confirmed") & (F.col("suggestion_score") >= least_score) & F.col("suggestion_contact_id").isNotNull(), F.lit(False))
    joined = speakers.where(may).join(able, F.col("suggestion_contact_id") == F.col("c"), "left").withColumn("auto_bound", F.coalesce("able", F.lit(False))).drop("c", "able")
    marked = joined.unionByName(speakers.where(~may).withColumn("auto_bound", F.lit(False)))
    return updated(marked, F.col("auto_bound"), contact_id=F.col("suggestion_contact_id"), confirmed=F.lit(True))


def write_version(table: DataFrame, folder: str, partition: str | None = None) -> str:
    """Writes a new version under folder and returns its path; readers of older versions aren't touched."""
    path = f"{folder}/v-{uuid.uuid4().hex}"
    writer = table.write.option("compression", "zstd")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return path


def overwrite_partitions(new: DataFrame, path: str, partition: str) -> None:
    """Replaces only the partitions that new holds."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
