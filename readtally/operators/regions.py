"""Region tables: (ord, ref, start, end, strand, id, aggr)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hull(regions: DataFrame) -> DataFrame:
    """Smallest start and largest end of each (ref, aggr)."""
    return regions.groupBy("ref", "aggr").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def collapse(regions: DataFrame) -> DataFrame:
    """Of equal (start, end, aggr) the first in file order stays. Contig, strand and id are not in the key."""
    first = F.row_number().over(Window.partitionBy("start", "end", "aggr").orderBy("ord"))
    return regions.withColumn("_n", first).where("_n = 1").drop("_n")


def rename(regions: DataFrame) -> DataFrame:
    """Second and later occurrences of (start, end, aggr) get the row number (``ord``, from 0 among the
    feature's rows) appended to their aggr and id."""
    n = F.row_number().over(Window.partitionBy("start", "end", "aggr").orderBy("ord"))
    named = lambda c: F.when(F.col("_n") > 1, F.concat(c, F.lit("-"), F.col("ord").cast("string"))).otherwise(F.col(c))
    return regions.withColumn("_n", n).withColumns({c: named(c) for c in ("id", "aggr")}).drop("_n")
