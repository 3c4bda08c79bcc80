"""Mixing sources to target weights, with DataFrame functions only.

Words are counted per source, targets follow from the sources' weights, and a source's repetition rate is its target
over its size. A document is emitted floor(rate) times, plus once more if a number derived from its id by a seeded hash
falls below the fraction (so reruns agree).

Targets: the budget (150 % of all words) is shared by weight; a target stops at ``MOST`` times its source's size and the
excess is shared by weight among the others, until none is above. That fixed point is min(MOST * size, level * weight)
with one level for all sources. Sorted by size over weight, the capped sources come first, so the level follows from
running sums over the table of sources.

Edge cases: null texts have no words, a null source is one source, the last; a source without words has rate 0; rows
that repeat a doc_id are drawn alike, those without one if their texts are equal; no documents, no rows. A very long text is counted in its row.

Bound: the table of sources, one narrow row each, passes one task (the level depends on all sources); documents do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readtally.llm.shared import packed, small, stored, unpacked

WEIGHTS = (5, 2, 1)
MOST = 2
SEED = "mix-1"
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def rates(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = MOST) -> DataFrame:
    """For each source: source, source_size, target, rate. The windows here run over the table of sources only."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    per = per.withColumn("all_size", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    per = per.withColumn("level", (F.col("all_size") * share - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
    # the level holds from the first source that it does not fill
    level = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(every)["level"]
    per = per.withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), level * F.col("weight")), F.col("cap").cast("double")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return per.select("source", "source_size", "target", rate.alias("rate"))


def chance(seed: str = SEED) -> Column:
    """Uniform number in [0, 1) from the document's id, or from its text if it has none."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce("text", F.lit("")))))
    digest = F.md5(F.concat(F.lit(seed + ":"), own))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / float(1 << 48)


def mixed(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with _size, _source_size, _target and _copies (how often the mix takes the document)."""
    sized = docs.withColumn("_size", word_count())
    table = stored(rates(sized.select("source", F.col("_size").alias("size"))), "rates")
    table = table.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("rate").alias("_rate"))
    out = sized.join(small(table), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    copies = F.floor("_rate") + (chance() < F.col("_rate") - F.floor("_rate")).cast("long")
    return out.withColumn("_copies", copies).drop("_rate")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = mixed(docs)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per emitted copy, numbered from 1."""
    out = mixed(packed(docs)).where("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return unpacked(out, docs.columns, "copy")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, 2 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS all_size, CAST(sum(weight) OVER () AS BIGINT) AS all_weight,
         CAST(coalesce(sum(2 * source_size) OVER b, 0) AS BIGINT) AS cap_before, CAST(coalesce(sum(weight) OVER b, 0) AS BIGINT) AS weight_before
  FROM s WINDOW b AS (ORDER BY 2 * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (all_size * CAST(1.5 AS DOUBLE) - cap_before) / CAST(all_weight - weight_before AS DOUBLE) AS level FROM c
), f AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE cap >= level * weight)
, t AS (
  SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), (SELECT level FROM f) * weight), CAST(cap AS DOUBLE)) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null ' || md5(coalesce(d.text, '')))), 1, 12) AS BIGINT) / CAST(281474976710656 AS DOUBLE) AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
