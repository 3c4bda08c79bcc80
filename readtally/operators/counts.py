"""Counts by region, by region and cell, and by status. A row counts ``n`` times where it has that column (reads of one alignment)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ["ambiguous", "barcode_not_in_whitelist", "correct", "duplicate", "filtered", "no_barcode", "no_umi", "outside", "reverse"]


def _times(rows: DataFrame):
    return F.col("n") if "n" in rows.columns else F.lit(1).cast("long")


def by_region(hits: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """id, count_correct, count_reverse; with ``keys`` (column id) all of these, 0 where unseen."""
    each = lambda side: F.sum(F.when(F.col("side") == side, _times(hits)).otherwise(0)).alias(f"count_{side}")
    seen = hits.groupBy("id").agg(each("correct"), each("reverse"))
    return seen if keys is None else keys.select("id").distinct().join(seen, "id", "left").na.fill(0)


def by_cell(hits: DataFrame) -> DataFrame:
    """id, barcode, count of the correct side."""
    return hits.where("side = 'correct'").groupBy("id", "barcode").agg(F.sum(_times(hits)).alias("count"))


def final_status(status, n_correct, n_reverse):
    return F.coalesce(status, F.when((n_correct > 0) & (n_reverse > 0), "ambiguous").when(n_correct > 0, "correct").when(n_reverse > 0, "reverse").otherwise("outside"))


def by_status(reads: DataFrame) -> DataFrame:
    """All nine statuses with counts."""
    spark = reads.sparkSession
    keys = spark.createDataFrame([(s,) for s in STATUSES], "stat string")
    return F.broadcast(keys).join(reads.groupBy(F.col("status").alias("stat")).agg(F.sum(_times(reads)).alias("count")), "stat", "left").na.fill(0).orderBy("stat")


@dataclass
class Dictionary:
    table: DataFrame  # name, index
    size: int
    held: DataFrame  # kept in memory and on disk, until ``release``

    def release(self) -> None:
        self.held.unpersist()


def dictionary(values: DataFrame, name: str) -> Dictionary:
    """Distinct values with their number, from 1, in byte order. Values are numbered inside sorted ranges, to which the
    sizes of the earlier ranges are added, so they are not gathered in one task; a row per range passes the driver."""
    spark = values.sparkSession
    ranged = values.select(name).distinct().repartitionByRange(F.col(name)).withColumn("_range", F.spark_partition_id())
    ranged = ranged.persist()
    sizes = sorted(tuple(r) for r in ranged.groupBy("_range").count().collect())
    before = [(r, sum(n for _, n in sizes[:i])) for i, (r, _) in enumerate(sizes)]
    offsets = F.broadcast(spark.createDataFrame(before, "_range int, _before long"))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(name))
    table = ranged.join(offsets, "_range").select(name, (F.col("_before") + at).alias("index"))
    return Dictionary(table, sum(n for _, n in sizes), ranged)
