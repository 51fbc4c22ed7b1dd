"""Artifacts of calls as text files, a folder for each call: <root>/call=<key>/<kind>-*.txt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_artifacts(rows: DataFrame, root: str) -> None:
    """rows: call, kind, text, one for each call and kind: its text is a whole file, ended by a line break."""
    rows.select("call", "kind", F.col("text").alias("value")).repartition("call").write.partitionBy("call", "kind").text(root)


def read_artifacts(spark: SparkSession, root: str, calls: DataFrame, kind: str) -> DataFrame:
    """call, text of every row of calls (call); null where the call has no such artifact."""
    files = spark.read.schema("value string, call string, kind string").text(root, wholetext=True).where(F.col("kind") == kind)
    return calls.select("call").join(files.select("call", F.regexp_replace("value", r"\n\z", "").alias("text")), "call", "left")


def remove_artifacts(spark: SparkSession, root: str, call: str | None = None) -> bool:
    """Deletes the folder of one call, or of all. True if there was one. A key is escaped as Spark writes it, so that it
    names a folder right below root whatever its characters; an empty one is an error."""
    if call == "":
        raise ValueError("an empty key of a call")
    jvm = spark._jvm
    folder = "" if call is None else "/call=" + jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(call)
    path = jvm.org.apache.hadoop.fs.Path(root + folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
