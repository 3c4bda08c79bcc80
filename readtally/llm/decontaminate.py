"""Benchmark decontamination by winnowing.

Texts and items are words (letters A-Z lowered). From every window of ``W`` successive word ``K``-grams the smallest
hash is kept (the rightmost of equal ones). A run of K + W - 1 = 13 shared words holds one whole window, so both sides
keep the same fingerprint: no such run is missed. Fingerprints of both sides are joined, an item counting once for each, and each
hit is extended: the runs of 13 words around it are looked up among the item's, and its words are marked where they are found. Items
of fewer than 13 words are looked up as one run of all their words. A text that repeats itself costs as many rows as
it has fingerprints, not as many as pairs of places.

If the benchmark has at most ``PREFILTER`` fingerprints, these and the items' runs are sent to the tasks, and a document is
decided on where it is scanned, without a shuffle. With a larger one the fingerprints of both sides are joined by Spark, and
texts and items are fetched for the documents with candidates only.

Edge cases: null and empty texts have no words and no hits; items without words are ignored; equal item ids count once;
each row of documents gives a row, repeated or not; an empty benchmark hits nothing, empty documents give an empty table.
A very long text is scanned in one task, in slices where rows are short; with a large benchmark its fingerprints are a list in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readtally.llm import vectors as V
from readtally.llm.shared import SQL_WORDS, discard, packed, small, stored, text_hash, unpacked, with_row_key

SPAN, K = 13, 5
W = SPAN - K + 1
PREFILTER = 1_000_000
_SHORT = np.uint64(0xA24BAED4963EE407)


def winnow(w: V.Words) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a slice: hashes and the word index (in the slice) of their grams, in order."""
    g, at = w.grams(K)
    if len(g) < W:
        return g[:0], at[:0]
    row = w.row[at]
    view = np.lib.stride_tricks.sliding_window_view(g, W)
    last = W - 1 - np.argmin(view[:, ::-1], axis=1)
    pick = (np.arange(len(view)) + last)[row[: len(view)] == row[W - 1 :]]
    pick = np.unique(pick)
    return g[pick], at[pick]


def short_grams(w: V.Words, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of m words, hashed apart from those of other lengths."""
    g, at = w.grams(m)
    return V.mix(g + _SHORT * np.uint64(m)), at


def _runs(w: V.Words, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``m`` words: those of SPAN, or the short items' of all their words."""
    return w.grams(m) if m == SPAN else short_grams(w, m)


def _item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each item with words: its key, length of runs, fingerprints and runs (both sorted, distinct)."""
    for batch in batches:
        at, ms, prints, runs = [], [], [], []
        for w in V.words(batch.column("item_text")):
            n = np.diff(w.word_bounds)
            h, where = winnow(w)
            row = w.row[where]
            for r in np.flatnonzero(n):
                m = min(SPAN, int(n[r]))
                g, begin = _runs(w, m)
                own = np.unique(V.signed(g[w.row[begin] == r]))
                at.append(w.first + r), ms.append(m), runs.append(own)
                prints.append(np.unique(V.signed(h[row == r])) if m == SPAN else own)
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (prints, runs)]
        keys = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("ik", "item_id")]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(ms, pa.int32()), *lists], names=["ik", "item_id", "m", "prints", "runs"])


def _prints(batch: pa.RecordBatch, lengths: list[int], known: np.ndarray | None) -> Iterator[tuple[V.Words, list[tuple[np.ndarray, np.ndarray]]]]:
    """The words of a batch, slice by slice, with the fingerprints among ``known`` (all, if None) and their words' numbers in the slice."""
    for w in V.words(batch.column("text")):
        found = []
        for h, at in [winnow(w), *(short_grams(w, m) for m in lengths)]:
            if known is not None:
                hit = V.in_sorted(h, known) >= 0
                h, at = h[hit], at[hit]
            found.append((h, at))
        yield w, found


def _marked(w: V.Words, row: int, places: dict[int, list[int]], items, runs: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[int, set]:
    """Words of a row that lie in the runs of items, and these items' ids. ``places``: by item key the words, numbered in the slice, at which
    fingerprints begin; ``items``: (id, m, runs) by key; ``runs``: the slice's runs by length, with their first words (filled here)."""
    first, last = w.word_bounds[row : row + 2]
    mark = np.zeros(last - first + 1, np.int64)
    hits = set()
    for ik, at in places.items():
        item_id, m, wanted = items[ik]
        if m not in runs:
            g, begin = _runs(w, m)
            runs[m] = V.signed(g), begin
        g, begin = runs[m]
        # a fingerprint of K words lies in the runs that begin up to m - K words before it
        starts = np.unique(np.asarray(at)[:, None] - np.arange(m - K + 1 if m == SPAN else 1))
        starts = starts[(starts >= first) & (starts + m <= last)]
        own = np.searchsorted(begin, starts)
        own = own[V.in_sorted(g[own], wanted) >= 0]
        if len(own):
            np.add.at(mark, begin[own] - first, 1)
            np.add.at(mark, begin[own] - first + m, -1)
            if item_id is not None:
                hits.add(item_id)
    return int((np.cumsum(mark)[:-1] > 0).sum()), hits


RESULT = "doc_id long, h long, n_words long, n_hit long, n_items long, items_sha256 string"


def _digest(hits: set) -> str:
    return hashlib.sha256(",".join(sorted(str(x) for x in hits)).encode()).hexdigest()


def _whole_scan(lengths: list[int], known, held):
    """Decides on each document where it is scanned. ``known``: broadcast of the benchmark's sorted fingerprints with the items of each
    (bounds and keys); ``held``: broadcast of (id, m, runs) by item key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, bounds, keys = known.value
        for batch in batches:
            n, n_hit = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            n_items, digest = np.zeros(batch.num_rows, np.int64), [_digest(set())] * batch.num_rows
            for w, found in _prints(batch, lengths, prints):
                n[w.first : w.first + w.n_rows] = np.diff(w.word_bounds)
                rows: dict[int, dict[int, list[int]]] = {}
                for h, at in found:
                    for k, a in zip(V.in_sorted(h, prints).tolist(), at.tolist(), strict=True):
                        places = rows.setdefault(int(w.row[a]), {})
                        for ik in keys[bounds[k] : bounds[k + 1]]:
                            places.setdefault(ik, []).append(a)
                runs: dict = {}
                for row, places in rows.items():
                    marked, hits = _marked(w, row, places, held.value, runs)
                    n_hit[w.first + row], n_items[w.first + row] = marked, len(hits)
                    digest[w.first + row] = _digest(hits)
            columns = [batch.column("doc_id"), batch.column("h"), pa.array(n), pa.array(n_hit), pa.array(n_items), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "n_words", "n_hit", "n_items", "items_sha256"])

    return run


def _doc_prints(lengths: list[int]):
    """Words and all fingerprints of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            hs, rows, poss = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for w, found in _prints(batch, lengths, None):
                n[w.first : w.first + w.n_rows] = np.diff(w.word_bounds)
                pos = w.position()
                for h, at in found:
                    hs.append(h), rows.append(w.first + w.row[at]), poss.append(pos[at])
            h, row, pos = np.concatenate(hs), np.concatenate(rows), np.concatenate(poss)
            order = np.argsort(row, kind="stable")
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32))
            prints = pa.StructArray.from_arrays([pa.array(V.signed(h)[order]), pa.array(pos[order].astype(np.int32))], names=["h", "pos"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(n), pa.ListArray.from_arrays(offsets, prints)], names=["doc_id", "h", "n_words", "prints"])

    return run


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks the words of documents that lie in runs of their candidates, which carry their items."""
    for batch in batches:
        n_hit, n_items, digest = [], [], []
        for text, found in zip(batch.column("text"), batch.column("candidates").to_pylist(), strict=True):
            (w,) = V.words(pa.array([text.as_py()]))  # one text is one slice
            items = {c["ik"]: (c["item_id"], c["m"], np.array(c["runs"], np.int64)) for c in found}
            marked, hits = _marked(w, 0, {c["ik"]: c["places"] for c in found}, items, {})
            n_hit.append(marked), n_items.append(len(hits)), digest.append(_digest(hits))
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string())], names=["uid", "n_hit", "n_items", "items_sha256"])


def contamination(docs: DataFrame, benchmark: DataFrame, prefilter: int = PREFILTER) -> DataFrame:
    """For each row of ``docs``: doc_id, h (text hash), n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).where("item_text is not null").distinct()
    items = items.withColumn("ik", F.xxhash64("item_id", F.col("item_id").isNull(), "item_text"))
    index = stored(items.mapInArrow(_item_prints, "ik long, item_id long, m int, prints array<long>, runs array<long>"), "index")
    lengths = [r[0] for r in index.where(F.col("m") < SPAN).select("m").distinct().collect()]  # at most SPAN - 1
    prints = stored(index.select("ik", F.explode("prints").alias("print")), "prints")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), "text")
    if prints.limit(prefilter + 1).count() <= prefilter:
        pairs = sorted((r["print"] % (1 << 64), r["ik"]) for r in prints.distinct().collect())
        unique, bounds = np.unique(np.array([p for p, _ in pairs], np.uint64), return_index=True)
        known = spark.sparkContext.broadcast((unique, np.append(bounds, len(pairs)).tolist(), [ik for _, ik in pairs]))
        # an item has a fingerprint for each W runs at least, so these are at most W * prefilter numbers
        held = spark.sparkContext.broadcast({r["ik"]: (r["item_id"], r["m"], np.array(r["runs"], np.int64)) for r in index.collect()})
        discard(index, prints)
        out = keyed.mapInArrow(_whole_scan(lengths, known, held), RESULT)
    else:
        out = _joined(keyed, lengths, prints, index)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _joined(keyed: DataFrame, lengths: list[int], prints: DataFrame, index: DataFrame) -> DataFrame:
    """The same by joins: fingerprints are met first, then texts and items are fetched for those documents that have candidates. Rows without any
    take no part in these joins."""
    scan = keyed.mapInArrow(_doc_prints(lengths), "doc_id long, h long, n_words long, prints array<struct<h:long,pos:int>>")
    scan = stored(scan.withColumn("uid", F.monotonically_increasing_id()), "document-prints", "zstd")
    hits = scan.select("uid", F.inline("prints")).join(prints, F.col("h") == F.col("print"))
    full = hits.groupBy("uid", "ik").agg(F.collect_set("pos").alias("places")).join(index.select("ik", "item_id", "m", "runs"), "ik")
    full = full.groupBy("uid").agg(F.collect_list(F.struct("ik", "places", "item_id", "m", "runs")).alias("candidates"))
    some = stored(full.join(scan.select("uid", F.col("doc_id").alias("_d"), F.col("h").alias("_h")), "uid"), "candidates", "zstd")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))
    texts = keyed.join(some.select("_d", "_h").distinct(), same, "left_semi").dropDuplicates(["doc_id", "h"])
    found = some.join(texts, same).select("uid", "text", "candidates").mapInArrow(_extend, "uid long, n_hit long, n_items long, items_sha256 string")
    none = {"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items_sha256": F.lit(_digest(set()))}
    out = scan.select("uid", "doc_id", "h", "n_words").join(found, "uid", "left")
    return out.select("doc_id", "h", "n_words", *(F.coalesce(c, v).alias(c) for c, v in none.items()))


def op7(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, benchmark).drop("h")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go. They are few, so the documents' texts stay where they are."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    bad = stored(found.select(F.struct(F.col("doc_id").alias("d"), "h").alias("_k")).distinct(), "contaminated")
    keyed = with_row_key(packed(docs)).alias("x")
    bad = small(bad).alias("y")
    same = F.col("x._k.d").eqNullSafe(F.col("y._k.d")) & (F.col("x._k.h") == F.col("y._k.h"))
    return unpacked(keyed.join(bad, same, "left_anti"), docs.columns)


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {SQL_WORDS} AS ws FROM documents),
i AS (SELECT DISTINCT item_id, {SQL_WORDS} AS ws FROM benchmark),
n AS (SELECT item_id, ws, least({SPAN}, len(ws)) AS m FROM i WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, m, array_to_string(ws[k : k + m - 1], ' ') AS g FROM (SELECT item_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM n)),
p AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM d),
r AS (SELECT rid, pos, list(word) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND {SPAN - 1} FOLLOWING) AS ws FROM p),
dw AS (SELECT rid, pos, m, array_to_string(ws[1 : m], ' ') AS g FROM r, (SELECT DISTINCT m FROM n) WHERE len(ws) >= m),
h AS (SELECT DISTINCT rid, pos, m, item_id FROM dw JOIN iw USING (m, g)),
c AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + m)) AS x FROM h) GROUP BY rid),
f AS (SELECT rid, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN f USING (rid)
"""
