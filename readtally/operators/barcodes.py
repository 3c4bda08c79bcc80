"""Correction of cell barcodes against whitelists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readtally.functions import reads as R


def correct(reads: DataFrame, whitelist: DataFrame | None, separator: str, max_hamming: int, n_lists: int | None = None) -> DataFrame:
    """Adds barcode, null where a segment has no entry. ``reads`` has raw_barcode; ``whitelist`` has segment (from 0), entry;
    ``n_lists`` is the number of whitelists, which an empty last one does not show (from the segments if None).

    Distinct raw barcodes are corrected, not reads, and only those without an exact entry meet the list. Segments beyond the whitelists are dropped, missing ones tolerated.
    An exact entry wins, else the closest within ``max_hamming``, else none; of equally close ones the first by name.
    The fuzzy join meets on pieces: with at most h errors one of h + 1 pieces of the entry is unchanged, so the pairs
    compared share a piece, and no pair of all words with all entries is made.
    """
    if whitelist is None:
        return reads.withColumn("barcode", F.when(F.col("raw_barcode") != "", F.col("raw_barcode")))
    raw = reads.where("raw_barcode is not null").select("raw_barcode").distinct()
    if n_lists is None:
        last = whitelist.agg(F.max("segment")).first()[0]
        n_lists = 0 if last is None else last + 1
    segments = raw.select("raw_barcode", F.posexplode(F.split("raw_barcode", "\\Q" + separator + "\\E")).alias("segment", "piece")).where(F.col("segment") < n_lists)
    words = segments.select("segment", "piece").distinct()

    def pieces(df: DataFrame, word: str) -> DataFrame:
        step = F.ceil((F.length(word) + 1) / (max_hamming + 1)).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.lit(max_hamming)), lambda i: F.struct(i.alias("no"), F.substring(F.col(word), i * step + 1, step).alias("part")))
        return df.withColumn("size", F.length(word)).select("*", F.inline(cut))

    entries = whitelist.select("segment", "entry").distinct()
    exact = words.join(entries.withColumn("piece", F.col("entry")), ["segment", "piece"], "left")
    if max_hamming:
        left = exact.where("entry is null").select("segment", "piece", R.packed_letters(F.col("piece")).alias("piece_code"))
        list_ = entries.withColumn("entry_code", R.packed_letters(F.col("entry")))
        near = pieces(left, "piece").join(pieces(list_, "entry"), ["segment", "size", "no", "part"])
        distance = F.coalesce(R.packed_hamming(F.col("piece_code"), F.col("entry_code")), R.hamming(F.col("piece"), F.col("entry")))
        near = near.withColumn("distance", distance).where(F.col("distance") <= max_hamming)
        best = near.groupBy("segment", "piece").agg(F.min(F.struct("distance", "entry"))["entry"].alias("near"))
        exact = exact.join(best, ["segment", "piece"], "left").withColumn("entry", F.coalesce("entry", "near"))
    fixed = segments.join(exact, ["segment", "piece"], "left").groupBy("raw_barcode").agg(F.sort_array(F.collect_list(F.struct("segment", "entry"))).alias("parts"))
    joined = F.when(~F.exists("parts", lambda x: x["entry"].isNull()), F.array_join(F.col("parts.entry"), separator))
    return reads.join(fixed.select("raw_barcode", joined.alias("barcode")), "raw_barcode", "left")
