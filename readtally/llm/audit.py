"""Audit of how filters interact, by Walsh-Hadamard sums.

Each document fails some of five conditions; the failures are a mask of five bits. For each part and label the 32 signed parity
sums of the masks are aggregated (the sum over documents of +1 or -1, by the parity of the mask's bits that a subset
selects). These sums are the Walsh-Hadamard transform of the mask counts, so the inverse transform gives the count of each mask
exactly, in integers (32 divides each result). What a filter removes in any order follows from the 32 counts: a document
goes at the first of its failures in the order, and over all 120 orders each of its k failures comes first in 120 / k.

Conditions: A fewer than 200 words; B 100 * distinct words < 50 * words; C 100 * letters A-Z > 2 * code points; D one of ``#$%&*|``;
E the text is that of a smaller doc_id. Words are runs of other characters than ASCII white space.

Edge cases: a null text is empty (A holds, and E if another is empty too); rows without an id fail E never and make no other
row fail it; rows that repeat an id and a text do not fail E by each other; a null source is the part of the empty one; a
document with several label rows is good, or toxic, if one of them says so; documents without a label are neither; an empty
table gives no rows. Texts are compared by SHA-256. A very long text is split into words within its row.

Texts are read once: what is kept of each is its id, part, four bits and digest. Equal texts meet in an aggregation with
partial results; its minima are joined back to the narrow rows, where adaptive execution splits a text that very many rows share.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtally.llm.shared import discard, small, stored

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
CELLS = 1 << len(FILTERS)
_BLANKS = "\t\n\x0b\x0c\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Words of a text; blanks become spaces first, so that one character divides them."""
    return F.array_remove(F.split(F.translate(text, _BLANKS, " " * len(_BLANKS)), " "), "")


def own_mask(text: Column, words: Column) -> Column:
    """Bits of the conditions A to D, which the text alone decides."""
    n, capitals = F.size(words), F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    tests = [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 2 * F.length(text), F.rlike(text, F.lit(r"[#$%&*|]"))]
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """For each row of ``docs``: part, mask, good, toxic; and the stored tables that these are read from."""
    text = F.coalesce("text", F.lit(""))
    # a generated row is made once; a plain column would be split again wherever it is named
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), F.inline(F.array(F.struct(words(text).alias("_words")))))
    seen = stored(seen.select("doc_id", "part", own_mask(F.col("text"), F.col("_words")).alias("own"), F.unhex(F.sha2("text", 256)).alias("digest")), "audit-rows", "zstd")
    first = seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("doc_id").alias("n")).where("n > 1")
    first = stored(first.select("digest", "first"), "audit-repeated")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id"))
    marks = marks.agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    marks = stored(marks.where("good or toxic"), "audit-labels")
    out = seen.join(small(first), "digest", "left").join(small(marks), seen["doc_id"] == marks["_id"], "left")
    again = F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    no = F.lit(False)
    out = out.select("part", (F.col("own") + again).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return out, (seen, first, marks)


def parity_sums(masked: DataFrame) -> DataFrame:
    """part, good, toxic and ``sums``: the 32 signed parity sums of ``mask``."""
    signs = [F.sum(1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2)).alias(f"s{s}") for s in range(CELLS)]
    return masked.groupBy("part", "good", "toxic").agg(*signs).select("part", "good", "toxic", F.array(*(f"s{s}" for s in range(CELLS))).alias("sums"))


def inverted(sums: Column) -> Column:
    """Counts of the masks from their parity sums: five butterfly steps, then an exact division by 32."""
    for i in range(len(FILTERS)):
        sums = _step(sums, 1 << i)
    return F.transform(sums, lambda x: F.shiftright(x, len(FILTERS)))


def _step(values: Column, bit: int) -> Column:
    """Sum and difference of the values whose places differ in one bit."""
    pick = lambda v: F.transform(v, lambda x, i: F.when(i.bitwiseAND(F.lit(bit)) == 0, x + F.get(v, i + bit)).otherwise(F.get(v, i - bit) - x))
    return F.element_at(F.transform(F.array(values), pick), 1)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    masked, used = masks(docs, labels)
    sums = stored(parity_sums(masked), "audit-sums")  # at most four rows a part
    discard(*used)
    counts = sums.select("part", "good", "toxic", F.posexplode(inverted(F.col("sums"))).alias("mask", "n"))
    each = counts.groupBy("part", "mask").agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )
    cells = each.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "all", "good", "toxic"))).alias("cells"))  # 32 of them
    orders = F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")
    out = cells.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = {1 << i: F.instr("filter_order", name) for i, name in enumerate(FILTERS)}
    bits = {"bit": lambda at: at == F.col("step"), "before": lambda at: at < F.col("step")}
    out = out.withColumns({n: sum((F.when(here(at), bit).otherwise(0) for bit, at in place.items()), F.lit(0)) for n, here in bits.items()})

    def total(value, where) -> Column:
        return F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda t, c: t + value(c))

    fails = lambda c: c["mask"].bitwiseAND(F.col("bit")) != 0
    share = F.array(*(F.lit(120 // k) for k in range(1, 6)))  # orders in which one of k failures comes first
    gone = lambda c: c["mask"].bitwiseAND(F.col("before")) != 0
    return out.select(
        "part", "filter_order", "step",
        total(lambda c: c["all"], lambda c: ~fails(c) & ~gone(c)).alias("kept"),
        total(lambda c: c["all"], lambda c: fails(c) & ~gone(c)).alias("removed"),
        total(lambda c: c["all"], lambda c: fails(c) & gone(c)).alias("redundant"),
        total(lambda c: c["all"], lambda c: c["mask"] == F.col("bit")).alias("unique_fails"),
        total(lambda c: c["good"], lambda c: fails(c) & ~gone(c)).alias("good_lost"),
        total(lambda c: c["toxic"], lambda c: fails(c) & ~gone(c)).alias("toxic_lost"),
        total(lambda c: F.element_at(share, F.bit_count(c["mask"]).cast("int")) * c["all"], fails).alias("shapley"),
    )


def op12(spark, sf_dir: str) -> DataFrame:
    return audit(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))


_ORDERS = ", ".join(f"('{''.join(o)}')" for o in permutations(FILTERS))
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
m AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * (length(t) - length(translate(t, '{_CAPITALS}', ''))) > 2 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(d.doc_id > first, false) AS e
  FROM d JOIN m USING (t) LEFT JOIN l ON d.doc_id = l.doc_id
), g AS (
  SELECT part, good, toxic, concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS fails, count(*) AS n
  FROM f GROUP BY ALL
), o(filter_order) AS (VALUES {_ORDERS}),
s AS (
  SELECT part, good, toxic, fails, n, filter_order, step, substr(filter_order, step, 1) AS name,
         len(list_filter(string_split(fails, ''), lambda x: x <> '' AND instr(substr(filter_order, 1, step - 1), x) > 0)) > 0 AS before
  FROM g, o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, name, sum(n) FILTER (NOT before AND NOT contains(fails, name)) AS kept, sum(n) FILTER (NOT before AND contains(fails, name)) AS removed,
         sum(n) FILTER (before AND contains(fails, name)) AS redundant, sum(n) FILTER (fails = name) AS unique_fails,
         sum(n) FILTER (NOT before AND contains(fails, name) AND good) AS good_lost, sum(n) FILTER (NOT before AND contains(fails, name) AND toxic) AS toxic_lost
  FROM s GROUP BY ALL
)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, name) AS BIGINT) AS shapley
FROM r
"""
