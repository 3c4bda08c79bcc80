"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word 5-grams (letters A-Z lowered); two are linked if the Jaccard similarity is 0.8 or more. The
result has a row for each document: its class (smallest doc_id among all documents that links connect) and its number of
links (other documents at 0.8 or more, copies included).

1. One scan makes each document's set identity (128 bits of its distinct grams) and MinHash values. Documents of equal
   sets are one node from here on; the count of a node is an aggregation with map-side partials.
2. Nodes meet in LSH buckets (30 bands of 5 MinHash values: a pair at 0.8 is missed with probability below 1e-5).
3. Within a bucket, MinHash values are compared in steps of 32. After each step a pair is dropped if the posterior
   probability that its similarity reaches 0.8 is below ``TOLERANCE``. What survives is written as a forest: each
   node points at one node of its survivors' component, so rows are as many as members, not pairs.
4. Connected components of the forests hold every pair that can reach 0.8 together. Inside, block by block, the pairs that
   pruning leaves are verified exactly on the 5-gram sets, and only counts per node and a forest of exact links leave
   the task.
5. Components of exact links are the classes.

Buckets and components of more than ``BLOCK`` members (components also by grams) are split into blocks and all pairs of
blocks are tasks of their own; no group is gathered whole, none is cut short. A group of m different near copies is m * m / ``BLOCK``
rows of gram sets, a square that counting all its links asks for.

Edge cases: fewer than five words are one gram of all words; null or empty texts have no gram and no link, each is its
own class; repeated rows are copies and linked; a null doc_id takes part, class null if all of a class are null. Empty tables
give empty tables. A very long text is one set in one task, and its component has fewer members to a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readtally.llm import vectors as V
from readtally.llm.shared import BROADCAST_ROWS, SQL_WORDS, components, packed, small, stored, text_hash, unpacked

GRAM, SIMILARITY = 5, 0.8
ROWS, BANDS, COMPARED, STEP = 5, 30, 128, 32
TOLERANCE = 1e-6
#: Most members of a block, and most grams of its sets on average (8 bytes each).
BLOCK, BLOCK_GRAMS = 1024, 1 << 22
_N = ROWS * BANDS
_RNG = np.random.Generator(np.random.PCG64(977))
_A = (_RNG.integers(1, 1 << 31, _N, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _RNG.integers(0, 1 << 32, _N, dtype=np.uint32)[:, None]


def gram_sets(w: V.Words) -> Iterator[tuple[int, np.ndarray]]:
    """Row (in the batch) and sorted distinct gram hashes, for rows that have words."""
    g, at = w.grams(GRAM)
    bounds = np.searchsorted(w.row[at], np.arange(w.n_rows + 1))
    for r in range(w.n_rows):
        if bounds[r] < bounds[r + 1]:
            yield w.first + r, np.unique(g[bounds[r] : bounds[r + 1]])
        elif w.word_bounds[r] < w.word_bounds[r + 1]:
            whole = w.hash[w.word_bounds[r] : w.word_bounds[r + 1]]
            total = (V.mix(whole + np.arange(1, len(whole) + 1, dtype=np.uint64))).sum(dtype=np.uint64)
            yield w.first + r, V.mix(np.array([total], np.uint64))


def set_identity(s: np.ndarray) -> bytes:
    """128 bits of a set of hashes: two independent sums of scrambled members."""
    a, b = V.mix(s + np.uint64(0x1F83D9ABFB41BD6B)).sum(dtype=np.uint64), V.mix(s ^ np.uint64(0x5BE0CD19137E2179)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def minhash(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)[None, :]
    out = np.full(_N, 0xFFFFFFFF, np.uint32)
    for i in range(0, x.shape[1], 2048):
        np.minimum(out, (x[:, i : i + 2048] * _A + _B).min(axis=1), out=out)
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = V.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1))
    for batch in batches:
        ident, bands, sig, size = ([None] * batch.num_rows for _ in range(4))
        for w in V.words(batch.column("text")):
            for r, s in gram_sets(w):
                m = minhash(s)
                key = seeds.copy()
                for j in range(ROWS):
                    key = V.mix(key ^ m[j::ROWS].astype(np.uint64))
                ident[r], bands[r], sig[r], size[r] = set_identity(s), V.signed(key), m[:COMPARED].astype(np.uint8).tobytes(), len(s)
        cols = [batch.column("doc_id"), batch.column("h"), pa.array(ident, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary()), pa.array(size, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "h", "node", "bands", "sig", "size"])


@cache
def least_matches(n: int, similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> int:
    """Fewest equal values among n at which the posterior probability of reaching ``similarity`` is not below tolerance.
    Uniform prior; one byte is compared, so unequal values agree with probability 1/256."""
    j = (np.arange(20000) + 0.5) / 20000
    p = j + (1 - j) / 256
    for m in range(n + 1):
        like = np.exp(m * np.log(p) + (n - m) * np.log1p(-p) - (m * np.log(max(m / n, 1e-9)) + (n - m) * np.log(max(1 - m / n, 1e-9))))
        if like[j >= similarity].sum() >= tolerance * like.sum():
            return m
    return n


def surviving(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index in a, index in b) that Bayesian pruning leaves."""
    left, right, seen = [], [], []
    for i in range(0, len(a), 128):
        for k in range(0, len(b), 128):
            count = (a[i : i + 128, None, :STEP] == b[None, k : k + 128, :STEP]).sum(axis=2, dtype=np.uint8)
            x, y = np.nonzero(count >= least_matches(STEP))
            left.append(x + i), right.append(y + k), seen.append(count[x, y].astype(np.int64))
    x, y, count = np.concatenate(left), np.concatenate(right), np.concatenate(seen)
    for n in range(STEP, COMPARED, STEP):
        count = count + (a[x, n : n + STEP] == b[y, n : n + STEP]).sum(axis=1)
        keep = count >= least_matches(n + STEP)
        x, y, count = x[keep], y[keep], count[keep]
    return x, y


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n members the smallest member of its component under the pairs (x, y)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups of sorted input, with the groups' bounds. The open group waits for more rows."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        code = t.column(key).combine_chunks().dictionary_encode()
        code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
        last = int(np.flatnonzero(np.diff(code, prepend=-1))[-1])
        rest = t.slice(last)
        if last:
            yield t.slice(0, last), np.append(np.flatnonzero(np.diff(code[:last], prepend=-1)), last)
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survivors of each bucket (or pair of blocks of one) as a forest."""
    for t, bounds in whole_groups(batches, "key"):
        node, side = t.column("node").to_pylist(), t.column("side").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, COMPARED)
        out_a, out_b = [], []
        xs, ys = [], []
        size = np.diff(bounds)
        group = np.repeat(np.arange(len(size)), size)
        for d in range(1, min(int(size.max()), 17)):  # groups of up to 16: all distances at once
            i = np.flatnonzero((group[:-d] == group[d:]) & (size[group[:-d]] <= 16) & ((side[:-d] != side[d:]) | (side[:-d] == 0)))
            count = np.zeros(len(i), np.int64)
            for n in range(0, COMPARED, STEP):
                count = count + (sig[i, n : n + STEP] == sig[i + d, n : n + STEP]).sum(axis=1)
                keep = count >= least_matches(n + STEP)
                i, count = i[keep], count[keep]
            xs.append(i), ys.append(i + d)
        for g in np.flatnonzero(size > 16):
            lo, hi = bounds[g], bounds[g + 1]
            # side 0: a block with itself; sides 1 and 2: two blocks, compared with each other
            a = lo + np.flatnonzero(side[lo:hi] != 2)
            b = lo + np.flatnonzero(side[lo:hi] != 1)
            x, y = surviving(sig[a], sig[b])
            x, y = a[x], b[y]
            xs.append(x[x != y]), ys.append(y[x != y])
        x, y = np.concatenate([np.empty(0, np.int64), *xs]), np.concatenate([np.empty(0, np.int64), *ys])
        label = forest(len(node), x, y)
        for i in np.flatnonzero(label != np.arange(len(node))):
            out_a.append(node[label[i]]), out_b.append(node[i])
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gram sets of the nodes' documents; a row whose text is not the node's (an equal hash) is dropped."""
    kept = ("label", "members", "grams_of", "node", "copies", "sig")
    for batch in batches:
        want = batch.column("node").to_pylist()
        rows, sets = [], []
        for w in V.words(batch.column("text")):
            for r, s in gram_sets(w):
                if set_identity(s) == want[r]:
                    rows.append(r), sets.append(s.tobytes())
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in kept] + [pa.array(sets, pa.binary())], names=[*kept, "grams"])


def exact_links(a: list[np.ndarray], b: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Matrix of whether the Jaccard similarity of sets a[i], b[j] is at least ``similarity``."""
    na, nb = np.array([len(s) for s in a]), np.array([len(s) for s in b])
    if len(a) * len(b) <= 16:
        both = np.array([[len(np.intersect1d(s, t, assume_unique=True)) for t in b] for s in a])
    else:
        ga, gb = np.concatenate(a), np.concatenate(b)
        known = np.intersect1d(np.unique(ga), np.unique(gb), assume_unique=True)
        ra, rb = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
        ca, cb = V.in_sorted(ga, known), V.in_sorted(gb, known)
        ra, ca, rb, cb = ra[ca >= 0], ca[ca >= 0], rb[cb >= 0], cb[cb >= 0]
        both = np.zeros((len(a), len(b)), np.float32)
        for lo in range(0, len(known), 2048):
            wide = min(2048, len(known) - lo)
            ma, mb = np.zeros((len(a), wide), np.float32), np.zeros((len(b), wide), np.float32)
            ia, ib = (ca >= lo) & (ca < lo + wide), (cb >= lo) & (cb < lo + wide)
            ma[ra[ia], ca[ia] - lo] = 1
            mb[rb[ib], cb[ib] - lo] = 1
            both += ma @ mb.T
    both = both.astype(np.int64)
    return 1000 * both >= round(1000 * similarity) * (na[:, None] + nb[None, :] - both)


def verified(a: list[np.ndarray], b: list[np.ndarray], sig_a: np.ndarray, sig_b: np.ndarray, one: bool) -> np.ndarray:
    """Matrix of exact links among the pairs that pruning leaves. ``one``: a and b are the same block. Few survivors are
    compared pair by pair, many at once."""
    link = np.zeros((len(a), len(b)), bool)
    x, y = surviving(sig_a, sig_b)
    if one:
        x, y = x[x < y], y[x < y]
    if 64 * len(x) < len(a) * len(b) or len(x) <= 16:
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            link[i, j] = exact_links([a[i]], [b[j]])[0, 0]
    else:
        survives = np.zeros_like(link)
        survives[x, y] = True
        link = exact_links(a, b) & survives
    return link | link.T if one else link


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links inside each component (or pair of its blocks): per node the linked documents, and a forest."""
    for t, bounds in whole_groups(batches, "key"):
        node, side, copies = t.column("node").to_pylist(), t.column("side").to_numpy(), t.column("copies").to_numpy()
        raw, sig = t.column("grams").to_pylist(), np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, COMPARED)
        out_a, out_b, out_n = [], [], []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            a, b = lo + np.flatnonzero(side[lo:hi] != 2), lo + np.flatnonzero(side[lo:hi] != 1)
            if not len(a) or not len(b):
                continue
            sets = {i: np.frombuffer(raw[i], np.uint64) for i in range(lo, hi)}
            one = side[lo] == 0
            link = verified([sets[i] for i in a], [sets[i] for i in b], sig[a], sig[b], one)
            x, y = np.nonzero(link)
            label = forest(hi - lo, a[x] - lo, b[y] - lo)
            n = np.zeros(hi - lo, np.int64)
            n[a - lo] += link @ copies[b]
            if not one:
                n[b - lo] += link.T @ copies[a]
            for i in range(hi - lo):
                if n[i]:
                    out_a.append(node[lo + label[i]]), out_b.append(node[lo + i]), out_n.append(n[i])
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary()), pa.array(out_n, pa.int64())], names=["a", "b", "n"])


def in_blocks(df: DataFrame, key: str, members: str, block: int = BLOCK, grams: str | None = None) -> DataFrame:
    """Rows of a group larger than ``block`` (or, by the group's column ``grams``, than ``BLOCK_GRAMS``) go to every pair of
    blocks that holds theirs. Adds key, side."""
    n = F.ceil(F.col(members) / block)
    n = (F.greatest(n, F.least(F.ceil(F.col(grams) / BLOCK_GRAMS), F.col(members))) if grams else n).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(7)), n).cast("int")
    df = df.withColumn("_n", n).withColumn("_own", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    side = F.when(F.col("_own") == F.col("_o"), 0).when(F.col("_own") < F.col("_o"), 1).otherwise(2)
    pair = F.xxhash64(F.col(key), F.least("_own", "_o"), F.greatest("_own", "_o"))
    return df.withColumn("side", side).withColumn("key", pair).drop("_n", "_own", "_o")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """For each row of ``docs``: doc_id, h (text hash), node (null without words), class_key, class_id, n_links. Classes
    whose smallest doc_id is the same (an id that comes with two texts) differ in class_key."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), "text")
    scan = stored(texts.mapInArrow(_scan, "doc_id long, h long, node binary, bands array<long>, sig binary, size long"), "minhash")
    # binary minima cannot be aggregated in place; the first signature of a node is as good as any, they are equal
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("rep")
    nodes = scan.where("node is not null").groupBy("node").agg(rep, F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("bands", "sig", "size")))
    nodes = stored(nodes.select("node", "rep.doc_id", "rep.h", "copies", "bands", "sig", "size"), "nodes")
    placed = nodes.select("node", F.explode("bands").alias("band"))
    # counted by aggregation and joined back: a bucket of very many members is never in one task
    met = stored(placed.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"), "buckets")
    placed = placed.join(met, "band")
    placed = placed.join(nodes.select("node", "sig"), "node")
    bucket = in_blocks(placed, "band", "members").select("key", "side", "node", "sig")
    edges = bucket.repartition("key").sortWithinPartitions("key").mapInArrow(_prune, "a binary, b binary")
    label = components(edges)
    # nodes of components with their gram sets, from the text of one document each
    members = label.join(nodes.select("node", "doc_id", "h", "copies", "sig", "size"), "node")
    totals = members.groupBy("label").agg(F.count("*").alias("members"), F.sum("size").alias("grams_of"))
    wanted = stored(members.drop("size").join(totals, "label"), "wanted")
    same = F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.h") == F.col("w.h"))
    grams = texts.alias("t").join(small(wanted, BROADCAST_ROWS // 4).alias("w"), same)
    grams = grams.select("t.text", *(f"w.{c}" for c in ("label", "members", "grams_of", "node", "copies", "sig")))
    # rows that repeat a document give its set again, and one of these stays
    grams = grams.mapInArrow(_sets, "label binary, members long, grams_of long, node binary, copies long, sig binary, grams binary").dropDuplicates(["node"])
    blocks = in_blocks(grams, "label", "members", grams="grams_of").select("key", "side", "node", "copies", "sig", "grams")
    links = stored(blocks.repartition("key").sortWithinPartitions("key").mapInArrow(_verify, "a binary, b binary, n long"), "links")
    final = components(links.select("a", "b"))
    counts = links.groupBy("b").agg(F.sum("n").alias("n")).withColumnRenamed("b", "node")
    linked = counts.join(final, "node").join(nodes.select("node", "doc_id"), "node")
    least = linked.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    linked = stored(linked.join(least, "label").select(F.col("node").alias("_node"), "label", "class_id", F.col("n").alias("linked")), "linked")
    many = stored(nodes.where("copies > 1").select(F.col("node").alias("_many"), F.col("doc_id").alias("first_id"), "copies"), "copies")
    out = scan.select("doc_id", "h", "node").join(small(linked), F.col("node") == F.col("_node"), "left").join(small(many), F.col("node") == F.col("_many"), "left")
    return out.select("doc_id", "h", "node", F.coalesce("label", "node").alias("class_key"), F.coalesce("class_id", "first_id", "doc_id").alias("class_id"), (F.coalesce("linked", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "n_links")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: that of the smallest doc_id; of rows that repeat it, one. The rows that go are
    joined by key, so texts stay where they are unless those are too many to broadcast."""
    table = stored(near_duplicates(docs).select("doc_id", "h", "node", "class_key"), "classes").where("node is not null")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    classes = stored(table.groupBy("class_key").agg(F.count("*").alias("n"), F.min(own).alias("keeper")).where("n > 1"), "keepers")
    ranked = table.join(classes, "class_key").select("doc_id", "h", F.when(own == F.col("keeper"), 1).otherwise(2).alias("rank"))
    gone = stored(ranked.distinct().select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "rank"), "near-duplicates")
    keyed = packed(docs).withColumn("_k", text_hash())
    out = keyed.join(small(gone), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_k") == F.col("_h")), "left").where("rank is null or rank = 1")
    single, repeated = out.where("rank is null"), out.where("rank = 1").dropDuplicates(["_d", "_h"])
    return unpacked(single.unionByName(repeated), docs.columns)


ORACLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {SQL_WORDS} AS ws FROM documents),
p AS (SELECT rid, unnest(ws) AS word, unnest(range(len(ws))) AS pos, len(ws) AS n FROM d),
r AS (SELECT rid, n, list(word) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND {GRAM - 1} FOLLOWING) AS ws, pos FROM p),
g AS (SELECT DISTINCT rid, array_to_string(ws, ' ') AS g FROM r WHERE len(ws) = {GRAM} OR (n < {GRAM} AND pos = 0)),
s AS (SELECT rid, count(*) AS n FROM g GROUP BY rid),
both_ AS (SELECT a.rid AS x, b.rid AS y, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
link AS (SELECT x, y FROM both_ JOIN s a ON a.rid = x JOIN s b ON b.rid = y WHERE 1000 * both_.n >= {round(1000 * SIMILARITY)} * (a.n + b.n - both_.n)),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
k AS (SELECT x AS rid, min(doc_id) AS least_ FROM reach JOIN d ON d.rid = y GROUP BY x),
c AS (SELECT x AS rid, count(*) AS n_links FROM link GROUP BY x)
SELECT doc_id, coalesce(least(doc_id, least_), doc_id, least_) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN k USING (rid) LEFT JOIN c USING (rid)
"""
