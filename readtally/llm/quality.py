"""Quality classifier by importance resampling.

Two generative models over hashed token n-grams (unigrams and bigrams of runs of letters/digits or of punctuation) are
counted: one from target text (labelled as good), one from the raw text, which is every document. A document's log
importance weight is the sum of its n-grams' log ratios. Documents are then drawn without replacement by Gumbel top-k:
the k largest values of ``tempered log weight + Gumbel noise``.

Long texts would dominate, so the weight is tempered by length: the mean log ratio times ``LENGTH``. k is the number
of documents whose mean log ratio lies on the good side of a cut fitted on the labelled sample.

Edge cases: null and empty texts have no n-gram and weight 0; without labels of both kinds nothing is rejected; rows
that repeat a doc_id with the same text get the same key and are kept or rejected together; no documents, no rows. A very long
text is counted and scored whole, as a slice of its own in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readtally.llm import vectors as V
from readtally.llm.shared import packed, put, stored, text_hash, unpacked

BUCKETS = 1 << 14
#: Bound of the labelled sample, drawn by hash of the id: target text and cut come from it.
LABELLED_ROWS = 20_000
LENGTH = 60.0
#: Pseudo-count that draws a bucket's ratio to 1, so that n-grams the sample did not meet say nothing.
SMOOTHING = 5.0
_PUNCT, _LETTER = 1, 2
_KINDS = np.array([_LETTER if V.WORD[b] else _PUNCT for b in range(256)], np.uint8)


@dataclass
class Model:
    ratio: np.ndarray  # log p_target - log p_raw by bucket
    cut: float  # least mean log ratio of accepted text
    kth: float  # k-th largest key
    k: int


def _buckets(w: V.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each uni- and bigram."""
    two, at = w.grams(2)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    two = (two >> shift).astype(np.int64)
    two[w.hash[at] == w.hash[at + 1]] = BUCKETS  # a token said twice is one kind of bigram
    return np.concatenate([(V.mix(w.hash) >> shift).astype(np.int64), two]), np.concatenate([w.row, w.row[at]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS + 1), np.int64)
    for batch in batches:
        good = np.asarray(batch.column("good").to_numpy(zero_copy_only=False), bool)
        for w in V.words(batch.column("text"), V.VISIBLE, _KINDS):
            bucket, row = _buckets(w)
            total[0] += np.bincount(bucket, minlength=BUCKETS + 1)
            total[1] += np.bincount(bucket[good[w.first + row]], minlength=BUCKETS + 1)
    at = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["bucket", "raw", "target"])


def _scorer(ratio: np.ndarray, schema: T.StructType):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for w in V.words(batch.column("text"), V.VISIBLE, _KINDS):
                bucket, row = _buckets(w)
                weight[w.first : w.first + w.n_rows] = np.bincount(row, ratio[bucket], w.n_rows)
                n[w.first : w.first + w.n_rows] = np.bincount(row, minlength=w.n_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(weight)], names=schema.names)

    return score


def _scored(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Adds _n, _weight (log importance weight), _mean and _key."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_n", T.LongType()), T.StructField("_weight", T.DoubleType())])
    out = docs.mapInArrow(_scorer(ratio, schema), schema)
    u = (F.xxhash64(F.lit("gumbel"), "doc_id", text_hash()).bitwiseAND(F.lit((1 << 52) - 1)) + 0.5) / float(1 << 52)
    mean = F.when(F.col("_n") > 0, F.col("_weight") / F.col("_n")).otherwise(0.0)
    return put(put(out, _mean=mean), _key=F.col("_mean") * LENGTH - F.log(-F.log(u)))


def _kth_largest(table: DataFrame, name: str, k: int, bins: int = 4096, most: int = 4096) -> float:
    """Exact k-th largest value: counts by bins narrow the range; at most ``most`` values are then looked at."""
    low, high = table.agg(F.min(name), F.max(name)).first()
    while True:
        at = F.least(F.floor((F.col(name) - low) / ((high - low) or 1.0) * bins), F.lit(bins - 1))
        inside = table.where(F.col(name).between(low, high))
        seen = 0
        for b, n, lo, hi in sorted((tuple(r) for r in inside.groupBy(at.alias("b")).agg(F.count("*"), F.min(name), F.max(name)).collect()), reverse=True):
            if seen + n >= k:
                break
            seen += n
        k, low, high = k - seen, lo, hi
        if low == high:
            return low
        if n <= most:
            return sorted((r[0] for r in table.where(F.col(name).between(low, high)).select(name).collect()), reverse=True)[k - 1]


def _cut(rows: list[tuple[float, int]]) -> float:
    """A quarter of the way from the low end (1 %) of good labelled text to the median of bad one: stray labels don't
    move it, and good text keeps a margin. Accepts all if one kind is missing or the two are in the wrong order."""
    good, bad = ([x for x, q in rows if (q > 0) == kind] for kind in (True, False))
    if not good or not bad or np.median(good) <= np.median(bad):
        return float("-inf")
    low = min(float(np.quantile(good, 0.01)), float(np.median(good)))
    return low - 0.25 * max(0.0, low - float(np.median(bad)))


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> tuple[Model, DataFrame]:
    """The model, and the stored scores (doc_id, _n, _weight, _mean, _key) of all documents."""
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    sample = stored(quality.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows), "labelled")  # bounded, so it may be broadcast
    good = F.broadcast(sample.where("q > 0").select("doc_id", F.lit(True).alias("good")))
    flagged = docs.select("doc_id", "text").join(good, "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counts = flagged.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for b, r, t in counts:
        raw[b] += r
        target[b] += t
    expected = raw * (target.sum() / max(raw.sum(), 1))  # of the target, if it were like the raw text
    ratio = np.log((target + SMOOTHING) / (expected + SMOOTHING)) if target.sum() else np.zeros(len(target))
    scores = stored(_scored(docs.select("doc_id", "text"), ratio).drop("text"), "scores")
    # a row for each labelled id; of an id's texts the least ratio counts
    known = scores.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("_mean"), F.min("q")).select("min(_mean)", "min(q)").collect()
    cut = _cut([tuple(r) for r in known])
    k = scores.where(F.col("_mean") >= cut).count()
    return Model(ratio, cut, _kth_largest(scores, "_key", k) if k else float("inf"), k), scores


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows of ``docs`` with their weight and decision: n_grams, log_weight, mean_log_ratio, gumbel_key, accepted."""
    model, _ = fit(docs, labels)
    out = _scored(packed(docs), model.ratio).withColumnsRenamed({"_n": "n_grams", "_weight": "log_weight", "_mean": "mean_log_ratio", "_key": "gumbel_key"})
    return unpacked(out.withColumn("accepted", F.col("gumbel_key") >= model.kth), docs.columns, "n_grams", "log_weight", "mean_log_ratio", "gumbel_key", "accepted")


def op1(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model, scores = fit(docs, labels)
    return scores.select("doc_id", F.col("_n").alias("n_grams"), F.col("_weight").alias("log_weight"), F.col("_mean").alias("mean_log_ratio"), F.col("_key").alias("gumbel_key"), (F.col("_key") >= model.kth).alias("accepted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    model, _ = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unpacked(_scored(packed(docs), model.ratio).where(F.col("_key") >= model.kth), docs.columns)
