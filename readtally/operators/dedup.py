"""Keeping the best read of each group of duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readtally.functions import reads as R

#: Best reads that are broadcast.
BROADCAST_BEST = 1_000_000


def mark_duplicates(reads: DataFrame, mode: str, bucket: Column | None, order: list[str]) -> DataFrame:
    """Sets the status ``duplicate`` on reads without a status that a better one of the same (ref, bucket, strand, umi
    [, barcode]) displaces. Better: higher NH (up to 255), then higher mapping quality, then earlier by ``order``, which is
    unique. Reads with a status take no part.

    With a bucket or barcode a group is a place or a cell, and a window sorts it. Without both (``bucket`` None, mode umi)
    a group is a share of a whole contig: its best read is aggregated, with partial results, and joined by ``order``."""
    if mode == "none":
        return reads
    live = F.col("status").isNull()
    best_nh, reverse = F.least(R.hits_number(), F.lit(255)), R.is_reverse(F.col("flag"))
    if mode == "umi" and bucket is None:
        best = reads.where(live).groupBy("ref", reverse.alias("_rev"), "umi").agg(F.min(F.struct((-best_nh).alias("nh"), (-F.col("mapq")).alias("q"), *order)).alias("b"))
        best = best.select(*(F.col(f"b.{c}").alias(f"_best_{c}") for c in order))
        same = [F.col(c) == F.col(f"_best_{c}") for c in order]
        # one row a contig, strand and UMI, counted first: if they are few, the reads are not shuffled
        best = best.persist()
        few = best.limit(BROADCAST_BEST + 1).count() <= BROADCAST_BEST
        out = reads.join(F.broadcast(best) if few else best, same, "left")
        twice = live & F.col(f"_best_{order[0]}").isNull()
        return out.withColumn("status", F.when(twice, "duplicate").otherwise(F.col("status"))).drop(*(f"_best_{c}" for c in order))
    keys = ["umi", "barcode"] if mode == "sc" else ["umi"]
    alone = F.when(~live, F.struct(*order))  # other reads are groups of their own, so they do not crowd one
    # keys are columns of their own, so that tags and CIGARs are not shuffled where nothing else needs them
    out = reads.withColumns({"_alone": alone, "_bucket": F.lit(0) if bucket is None else bucket, "_rev": reverse, "_nh": best_nh})
    window = Window.partitionBy("_alone", "ref", "_bucket", "_rev", *keys).orderBy(F.col("_nh").desc(), F.col("mapq").desc(), *order)
    out = out.withColumn("_place", F.row_number().over(window))
    return out.withColumn("status", F.when(live & (F.col("_place") > 1), "duplicate").otherwise(F.col("status"))).drop("_alone", "_bucket", "_rev", "_nh", "_place")


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers of a column's values; a null has one of its own."""
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _later(columns: list[pa.Array], own: np.ndarray) -> np.ndarray:
    """Of the rows ``own`` those that a better one of the same bucket, strand, umi and barcode displaces."""
    bucket, reverse, umi, barcode, nh, mapq, order = (c.take(pa.array(own)) for c in columns)
    group = [_codes(umi), _codes(barcode), reverse.to_numpy(zero_copy_only=False), bucket.to_numpy(zero_copy_only=False)]
    rank = [order.to_numpy(zero_copy_only=False), -mapq.to_numpy(zero_copy_only=False).astype(np.int64), -nh.to_numpy(zero_copy_only=False).astype(np.int64)]
    by = np.lexsort([*rank, *group])
    same = np.ones(max(len(by) - 1, 0), bool)
    for g in group:
        same &= g[by][1:] == g[by][:-1]
    return own[by[1:][same]]


def _keep_best(reach: int):
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        held: list[pa.Array] | None = None  # live, position, then the columns of ``_later``
        known = np.empty(0, np.int8)  # 1: displaced, 0: not, -1: not decided yet
        for batch in batches:
            held = list(batch) if held is None else [pa.concat_arrays([a, b]) for a, b in zip(held, batch, strict=True)]
            live = held[0].to_numpy(zero_copy_only=False)
            known = np.append(known, np.full(len(live) - len(known), -1, np.int8))
            known[~live] = 0
            if not len(live):
                continue
            bucket = held[2].to_numpy(zero_copy_only=False)
            closed = np.flatnonzero((known < 0) & (bucket < held[1][-1].as_py() - reach))
            known[closed] = 0
            known[_later(held[2:], closed)] = 1
            n = len(known) if (known >= 0).all() else int(np.argmax(known < 0))
            if n:
                yield pa.array(known[:n] == 1)
                held, known = [c.slice(n) for c in held], known[n:]
        if len(known):
            rest = np.flatnonzero(known < 0)
            known[rest] = 0
            known[_later(held[2:], rest)] = 1
            yield pa.array(known == 1)

    return run


def mark_inside_partitions(reads: DataFrame, mode: str, reach: int) -> DataFrame:
    """``mark_duplicates`` by position without a shuffle, for reads (with ord, pos and corrected) whose partitions are sorted by position, lie on one contig and
    hold whole buckets. A bucket is decided when the scan is ``reach`` bases behind it; until then a task holds the narrow columns of its reads,
    and Spark keeps the other columns beside the function."""
    live = F.col("status").isNull()
    cell = F.col("barcode") if mode == "sc" else F.lit(None).cast("string")
    nh = F.when(live, F.least(R.hits_number(), F.lit(255))).otherwise(0).cast("int")
    twice = F.arrow_udf(_keep_best(reach), "boolean")
    found = twice(live, "pos", F.col("corrected").cast("int"), R.is_reverse(F.col("flag")), "umi", cell, nh, "mapq", "ord")
    return reads.withColumn("_twice", found).withColumn("status", F.when(F.col("_twice"), "duplicate").otherwise(F.col("status"))).drop("_twice")
