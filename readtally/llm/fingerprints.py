"""Document fingerprints by winnowing, with DataFrame functions only.

A text is a sequence of tokens: pieces between spaces and newlines; a piece of more than ``LONG_TOKEN`` characters (writing
without spaces) is cut into characters, whatever stands around it. K successive tokens make a gram with a rolling hash, a cyclic
polynomial: hashes of tokens are rotated by their distance from the gram's end and joined by XOR. That hash is made of
those of its halves, so a gram costs three steps at any K up to 8. From each window of W grams the smallest
(mixed) hash is kept, the rightmost of equal ones, with its position: two texts that share K + W - 1 tokens in a row share a
kept gram. For the minimum, 33 bits of the hash and the position (31 bits, as long as any array) share one long; what is
kept has all 64 bits of the hash. Sliding minima double their width in each step.

Edge cases: a null text is an empty text, whose fingerprint is empty; fewer than K tokens give one hash of all, fewer
than W grams their minimum. Two empty fingerprints are alike (1), an empty and another are not (0). Repeated rows and equal ids
with two texts are rows of their own, in the order of their text hash; in a table of one row the next document is that row itself; an
empty table gives an empty table. A very long text is an array in one row; its work is linear in its tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readtally.llm.shared import text_hash

K, W = 5, 16
_LOW = (1 << 31) - 1
LONG_TOKEN = 24
#: Ranges of ids in which the next document is looked for: bytes of text in one, and most ranges.
RANGE_BYTES, RANGES = 64 << 20, 16_384


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shifted(a: Column, by: int, length: Column, combine) -> Column:
    """combine(a[i], a[i + by]) for the first ``length`` places."""
    n = F.greatest(length, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(by + 1), n), combine)


def tokens(text: Column) -> Column:
    def cut(p: Column) -> Column:
        pieces = F.transform(p, lambda x: F.when(F.length(x) > LONG_TOKEN, F.split(x, "")).otherwise(F.array(x)))
        return F.when(F.exists(p, lambda x: F.length(x) > LONG_TOKEN), F.flatten(pieces)).otherwise(p)

    return let(F.array_remove(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), ""), cut)


def _rolled(by: int) -> Callable[[Column, Column], Column]:
    """Joins the hash of a run with that of the ``by`` tokens after it."""
    return lambda a, b: F.shiftleft(a, by).bitwiseOR(F.shiftrightunsigned(a, 64 - by)).bitwiseXOR(b)


def winnow(text: Column) -> Column:
    """Kept grams in order: array of structs hash (long), position (int)."""

    def grams(h: Column) -> Column:
        n = F.size(h)
        four = let(_shifted(h, 1, n - 1, _rolled(1)), lambda g: _shifted(g, 2, n - 3, _rolled(2)))
        m = F.greatest(n - 4, F.lit(0))
        return F.zip_with(F.slice(four, F.lit(1), m), F.slice(h, F.lit(5), m), lambda a, b: F.xxhash64(_rolled(1)(a, b)))

    def keep(g: Column) -> Column:
        coded = F.transform(g, lambda x, i: x.bitwiseAND(F.lit(~_LOW)).bitwiseOR((F.lit(_LOW) - i).cast("long")))
        n = F.size(g)
        low = lambda a, b: F.least(a, b)
        wide = let(coded, lambda c: let(_shifted(c, 1, n - 1, low), lambda c: let(_shifted(c, 2, n - 3, low), lambda c: let(_shifted(c, 4, n - 7, low), lambda c: _shifted(c, 8, n - 15, low)))))
        kept = F.when(n >= W, F.array_distinct(wide)).otherwise(F.array(F.array_min(coded)))
        at = F.transform(kept, lambda x: (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))).cast("int"))
        return F.transform(at, lambda i: F.struct(F.get(g, i).alias("hash"), i.alias("position")))

    whole = F.array(F.struct(F.xxhash64(text).alias("hash"), F.lit(0).alias("position")))
    hashes = F.transform(tokens(text), lambda t: F.xxhash64(t))
    none = F.array().cast("array<struct<hash:long,position:int>>")
    return let(hashes, lambda h: F.when(F.length(text) == 0, none).when(F.size(h) < K, whole).otherwise(let(grams(h), keep)))


def text_form(kept: Column) -> Column:
    """hash:position, in order."""
    return F.array_join(F.transform(kept, lambda x: F.concat(F.lower(F.hex(x["hash"])), F.lit(":"), x["position"].cast("string"))), ",")


def hashes(kept: Column) -> Column:
    return F.array_distinct(kept["hash"])


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: let(F.size(F.array_intersect(s["a"], s["b"])), lambda n: F.when((F.size(s["a"]) == 0) & (F.size(s["b"]) == 0), 1.0).when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), 0.0).otherwise(n / (F.size(s["a"]) + F.size(s["b"]) - n))))


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Adds next_<c> of the next row in descending doc_id (nulls last; equal ids by text hash; after the last row: the first).

    Ids are cut into ranges at quantiles (of ``RANGE_BYTES`` of text, at most ``RANGES``), rows without an id by their text
    hash; a window runs inside each range, and the first row of the next range is put at the end of it. Only the ranges'
    bounds and first keys pass the driver.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(1, min(RANGES, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)))
    points = [i / wanted for i in range(1, wanted)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", points, 20 * wanted)).first()[0] or [])) if points else []
    steps = max(1, len(bounds).bit_length())
    cuts = F.array(*[F.lit(b) for b in bounds]).cast("array<long>")
    # binary search: number of bounds not above the id
    at = F.aggregate(
        F.array(*[F.lit(1 << (steps - 1 - i)) for i in range(steps)]),
        F.lit(0),
        lambda n, step: F.when((n + step <= len(bounds)) & (F.try_element_at(cuts, n + step) <= F.col("doc_id")), n + step).otherwise(n),
    )
    ranged = docs.withColumn("_h", text_hash())
    without = (F.shiftright("_h", 58) - 32).cast("int")  # -64 to -1
    ranged = ranged.withColumn("_range", F.when(F.col("doc_id").isNull(), without).otherwise(at))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_h")
    first = sorted((r["_range"], r["top"]["doc_id"], r["top"]["_h"]) for r in ranged.groupBy("_range").agg(F.max(order).alias("top")).collect())
    if not first:
        return docs.withColumns({f"next_{c}": F.col(c) for c in carried})
    tails = [(first[i][0], *first[i - 1][1:]) for i in range(len(first))]  # the lowest range is followed by the first row of all
    tail = F.broadcast(spark.createDataFrame(tails, "_to int, _d long, _t long"))  # at most RANGES + 1 rows
    ends = ranged.join(tail, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t"))).withColumn("_range", F.col("_to")).select(ranged.columns)
    rows = ranged.withColumn("_tail", F.lit(False)).unionByName(ends.withColumn("_tail", F.lit(True)))
    window = Window.partitionBy("_range").orderBy("_tail", F.col("doc_id").desc_nulls_last(), F.col("_h").desc())
    out = rows.withColumns({f"next_{c}": F.lead(c).over(window) for c in carried}).where(~F.col("_tail"))
    return out.drop("_range", "_h", "_tail")


def fingerprint(docs: DataFrame) -> DataFrame:
    """All rows with fingerprint_grams: array of (hash, position)."""
    return docs.withColumn("fingerprint_grams", winnow(F.coalesce("text", F.lit(""))))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs.withColumn("kept", winnow(F.col("text"))), ["text", "kept"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    docs = docs.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    docs = docs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "kept", winnow(F.col("edited")).alias("kept_edited"), hashes(F.col("next_kept")).alias("of_next"))
    docs = docs.withColumn("own", hashes(F.col("kept")))
    return docs.select("doc_id", "n_chars", "edited_sha256", text_form(F.col("kept")).alias("fingerprint"), text_form(F.col("kept_edited")).alias("edited_fingerprint"), likeness(F.col("own"), hashes(F.col("kept_edited"))).alias("near_edited"), likeness(F.col("own"), F.col("of_next")).alias("near_next"))
