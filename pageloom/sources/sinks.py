"""Sinks: JSON lines, metric tables, logs and atomic snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def metrics_csv(metrics: DataFrame) -> DataFrame:
    """(metric, value) with six places, in order of the metric."""
    return metrics.select("metric", F.format_string("%.6f", F.col("value").cast("double")).alias("value")).orderBy("metric")


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    metrics_csv(metrics).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_log(stages: DataFrame, path: str) -> None:
    """One JSON line for each stage, added to what is there."""
    stages.write.mode("append").json(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the old table, then put the new one in its place by renaming."""
    spark = df.sparkSession
    jvm = spark._jvm
    new, old, at = (jvm.org.apache.hadoop.fs.Path(p) for p in (path + ".new", path + ".old", path))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(path + ".new")
    fs.delete(old, True)
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(new, at)
    fs.delete(old, True)


def compare_report(compared: DataFrame) -> DataFrame:
    """A Markdown table row for each metric of a comparison; the formatting needs no driver."""
    f = lambda c: F.format_string("%.4f", F.col(c))
    return compared.select("metric", F.concat(F.lit("| "), "metric", F.lit(" | "), f("baseline"), F.lit(" | "), f("current"), F.lit(" | "), F.format_string("%+.4f", F.col("delta")), F.lit(" |")).alias("line"))
