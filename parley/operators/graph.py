"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (as in tests)
    takes one in the warehouse; on a cluster that is an error, as executors may not share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    local = spark.sparkContext.master.split("[")[0] == "local"
    if not folder and not local:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files behind a stored table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame) -> DataFrame:
    """links: two columns a, b. Returns node, root: every node of a link with the smallest node it can reach.

    Self links and repeated links change nothing; no links give no rows. Each round is a written table, deleted after the
    next; the number of rounds grows with the logarithm of the longest path. Hubs are pre-aggregated before they are joined.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = stored(edges, "links"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            break
        before, last = now, edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        removed(last)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with the place of each row in an order, from 1: rows are sorted in ranges, and a range's places begin where those
    before it end. Rows of equal order have places of their own; columns starting with two underscores aren't allowed."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Within a task the number rises by one a row, from the task's own start.
    placed = stored(ranged.withColumn("__row", F.monotonically_increasing_id()).withColumn("__at", F.shiftright("__row", 33)), "numbered")
    sizes = placed.groupBy("__at").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__at", F.coalesce(F.sum("__n").over(Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row a task
    within = F.col("__row") - F.shiftleft("__at", 33)
    return placed.join(before, "__at").withColumn(name, (F.col("__before") + within + 1).cast("long")).drop("__at", "__row", "__before")
