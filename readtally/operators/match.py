"""Matching reads to regions. Each read gets two lists of region ids in text order, hits_correct and hits_reverse.

Overlapping regions of one id are merged first (``merged``), so what a read meets is bounded by ids, not by regions. Up to ``BROADCAST_REGIONS`` rows they are sent to the tasks as sorted
arrays, and the blocks of a batch of reads are matched there at once, so no read is shuffled and all decisions on a read
are made where it lies. With more, reads and regions meet in cells of the contigs, in one shuffle (``swept``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from readtally.functions import reads as R

#: Regions that are broadcast (some 40 bytes each), and bytes of their names.
BROADCAST_REGIONS, BROADCAST_BYTES = 2_000_000, 256 << 20
#: Pairs of blocks and regions that a task looks at together.
PAIRS = 1 << 22
#: Room for positions on a contig in a sorting key.
_CONTIG = 1 << 33
#: Widths of cells, in bits, and reads of a cell that a task takes.
LEVELS, CROWD = (20, 24, 28, 31), 1_000_000
_REGION = "struct<ref:string,start:bigint,end:bigint,strand:string,id:string>"
HITS = "struct<correct:array<string>,reverse:array<string>>"


class RegionIndex:
    """Regions by length class (powers of 4), sorted by contig and start: those that may overlap [s, e) start between
    s - longest of the class and e."""

    def __init__(self, table: pa.Table) -> None:
        at = {c: i for i, c in enumerate(table.column_names)}
        column = lambda c: table.column(at[c]).combine_chunks()
        self.names, ids = np.unique(np.array(column("id").to_pylist(), object), return_inverse=True) if len(table) else (np.empty(0, object), np.empty(0, np.int64))
        contigs, ref = np.unique(np.array(column("ref").to_pylist(), object), return_inverse=True) if len(table) else (np.empty(0, object), np.empty(0, np.int64))
        self.contigs = {c: i for i, c in enumerate(contigs)}
        start, end = (np.asarray(column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("start", "end"))
        strand = np.array([{"+": 1, "-": 2}.get(x, 0) for x in column("strand").to_pylist()], np.int8)
        kind = np.ceil(np.log2(np.maximum(end - start, 1)) / 2).astype(np.int64)
        self.classes = []
        for k in np.unique(kind[end > start]):
            own = np.flatnonzero((kind == k) & (end > start))
            own = own[np.argsort(ref[own] * _CONTIG + start[own], kind="stable")]
            self.classes.append((int((end - start)[own].max()), ref[own] * _CONTIG + start[own], start[own], end[own], strand[own], ids[own]))

    def candidates(self, ref: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each class the range of regions that each block may overlap."""
        base = ref * _CONTIG
        return [(np.searchsorted(key, base + np.maximum(s - longest + 1, 0)), np.searchsorted(key, base + e)) for longest, key, *_ in self.classes]

    def pairs(self, ranges: list[tuple[np.ndarray, np.ndarray]], s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
        """Overlapping (block, id, strand, start, end of the common part)."""
        out = []
        for (lo, hi), (_, _, start, end, strand, ids) in zip(ranges, self.classes, strict=True):
            n = np.maximum(hi - lo, 0)
            block = np.repeat(np.arange(len(s)), n)
            region = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            met = (end[region] > s[block]) & (start[region] < e[block])
            block, region = block[met], region[met]
            out.append((block, ids[region], strand[region], np.maximum(start[region], s[block]), np.minimum(end[region], e[block])))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 5


def _decide(group: np.ndarray, s: np.ndarray, e: np.ndarray, bases: np.ndarray, overlap: str, multi_region: str, n_ids: int) -> np.ndarray:
    """Kept groups (read, side, id in one number) of overlapping parts, sorted."""
    if overlap == "union":
        kept = np.unique(group)
    else:
        order = np.lexsort((e, s, group))
        group, s, e = group[order], s[order], e[order]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(group))))
        reach = np.maximum.accumulate(e + number * _CONTIG)  # ends seen so far in the group
        before = np.where(np.diff(number, prepend=-1) > 0, 0, np.append(0, reach[:-1]) - number * _CONTIG)
        covered = np.add.reduceat(np.maximum(0, e - np.maximum(s, before)), first) if len(first) else np.empty(0, np.int64)
        kept = group[first]
        inside = covered == bases[kept // n_ids // 2]
        if overlap == "intersection_non_empty":
            some = np.zeros(2 * len(bases), bool)
            some[kept[inside] // n_ids] = True
            inside |= ~some[kept // n_ids]
        kept = kept[inside]
    if multi_region == "drop":
        kept = kept[np.bincount(kept // n_ids, minlength=2 * len(bases))[kept // n_ids] == 1]
    return kept


def _match(index: RegionIndex, ref: np.ndarray, reverse: np.ndarray, bounds: np.ndarray, s: np.ndarray, e: np.ndarray, overlap: str, multi_region: str, direction: str) -> np.ndarray:
    """Kept (read, side, id) of a batch, each as one number. ``bounds``: the blocks of each read."""
    n_reads, n_ids = len(ref), max(len(index.names), 1)
    read = np.repeat(np.arange(n_reads), np.diff(bounds))
    bases = np.bincount(read, (e - s), n_reads).astype(np.int64)
    use = np.flatnonzero((ref[read] >= 0) & (e > s))
    read, s, e = read[use], s[use], e[use]
    ranges = index.candidates(ref[read], s, e)
    load = np.cumsum(sum((np.maximum(hi - lo, 0) for lo, hi in ranges), np.zeros(len(read), np.int64)))
    kept, at = [np.empty(0, np.int64)], 0
    while at < len(read):  # whole reads of about PAIRS pairs
        end = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + PAIRS, side="right")))
        end = int(np.searchsorted(read, read[end - 1], side="right"))
        own = slice(at, end)
        block, ids, strand, ps, pe = index.pairs([(lo[own], hi[own]) for lo, hi in ranges], s[own], e[own])
        r = read[own][block]
        if direction == "ignore":
            side = np.zeros(len(r), np.int64)
        else:
            same = reverse[r] == (strand == 2)
            side = ((strand > 0) & (same if direction == "reverse" else ~same)).astype(np.int64)
        kept.append(_decide((r * 2 + side) * n_ids + ids, ps, pe, bases, overlap, multi_region, n_ids))
        at = end
    return np.concatenate(kept)


def _hits(found: RegionIndex, ref: pa.Array, reverse: pa.Array, blocks: pa.Array, overlap: str, multi_region: str, direction: str) -> list[pa.Array]:
    """For a batch of reads the lists of ids on the correct and on the reverse side."""
    code = ref.dictionary_encode()
    known = np.array([found.contigs.get(x, -1) for x in code.dictionary.to_pylist()] + [-1], np.int64)
    contig = known[code.indices.fill_null(len(known) - 1).to_numpy()]
    blocks = blocks.fill_null([])
    flat = blocks.flatten()
    bounds = np.append(0, np.cumsum(blocks.value_lengths().to_numpy()))
    s, e = (np.asarray(flat.field(i).to_numpy(zero_copy_only=False), np.int64) for i in (0, 1))
    kept = _match(found, contig, reverse.to_numpy(zero_copy_only=False), bounds, s, e, overlap, multi_region, direction)
    n_ids, names, lists = max(len(found.names), 1), pa.array(found.names, pa.string()), []
    for side in (0, 1):
        own = kept[kept // n_ids % 2 == side]
        offsets = np.append(0, np.cumsum(np.bincount(own // n_ids // 2, minlength=len(ref))))
        lists.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), names.take(pa.array(own % n_ids))))
    return lists


def _matcher(index, overlap: str, multi_region: str, direction: str):
    """``index``: broadcast of a RegionIndex."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        found: RegionIndex = index.value
        for ref, reverse, blocks in batches:
            lists = _hits(found, ref, reverse, blocks, overlap, multi_region, direction)
            yield pa.StructArray.from_arrays(lists, names=["correct", "reverse"])

    return run


def _cell(least, most):
    """The smallest cell that holds [least, most): a level's bits, and the cell's number."""
    inside = [(bits, F.shiftright(least, bits)) for bits in LEVELS]
    same = lambda bits: F.shiftright(least, bits) == F.shiftright(most - 1, bits)
    return F.coalesce(*[F.when(same(bits), F.struct(F.lit(bits).alias("bits"), at.cast("int").alias("cell"))) for bits, at in inside])


def _sweeper(columns: list[str], overlap: str, multi_region: str, direction: str):
    """Rows come by cell, a cell's regions before its reads; the reads of each batch are matched to the cell's regions at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, regions, index = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = pa.StructArray.from_arrays([batch.column(c).fill_null(-1) if c != "_ref" else batch.column(c).fill_null("") for c in _KEY], names=list(_KEY)).to_pylist()
            kind = batch.column("_kind").to_numpy(zero_copy_only=False)
            begin = 0
            while begin < len(keys):
                end = begin + 1
                while end < len(keys) and kind[end] == kind[begin] and keys[end] == keys[begin]:
                    end += 1
                part, own = batch.slice(begin, end - begin), keys[begin]
                if own != key:
                    key, regions, index = own, [], None
                if kind[begin] == 0:
                    regions.append(part.column("_region"))
                else:
                    index = index or _index(regions)
                    yield _matched(index, part, columns, overlap, multi_region, direction)
                begin = end

    return run


_KEY = ("_ref", "_bits", "_cell", "_salt")


def _index(regions: list[pa.StructArray]) -> RegionIndex:
    """Regions of one cell; ``ref`` is that of the cell."""
    names = ("ref", "start", "end", "strand", "id")
    empty = pa.table({"ref": pa.array([], pa.string()), "start": pa.array([], pa.int64()), "end": pa.array([], pa.int64()), "strand": pa.array([], pa.string()), "id": pa.array([], pa.string())})
    if not regions:
        return RegionIndex(empty)
    return RegionIndex(pa.table({n: pa.chunked_array([r.field(n) for r in regions]) for n in names}))


def _matched(index: RegionIndex, part: pa.RecordBatch, columns: list[str], overlap: str, multi_region: str, direction: str) -> pa.RecordBatch:
    read = part.column("_read")
    hits = _hits(index, read.field("_own_ref"), read.field("_rev"), read.field("_blocks"), overlap, multi_region, direction)
    return pa.RecordBatch.from_arrays([*(read.field(c) for c in columns), *hits], names=[*columns, "hits_correct", "hits_reverse"])


def swept(reads: DataFrame, regions: DataFrame, overlap: str, multi_region: str, direction: str) -> DataFrame:
    """Adds hits_correct, hits_reverse in one shuffle of the reads. A contig is divided into cells of several widths; a read belongs to
    the smallest cell that holds all of its blocks, and regions are copied to the cells of every width that they touch and that have
    reads. In a task the rows of a cell follow each other, regions first, so a cell's reads are never gathered. Reads of a cell
    are counted first, and those of a crowded one are dealt to several tasks, to each with the cell's regions."""
    columns = reads.columns
    live = F.col("status").isNull()
    none = F.array().cast("array<struct<s:int,e:int>>")
    df = reads.withColumn("_blocks", F.when(live, R.blocks(F.col("cigar"), F.col("pos"))).otherwise(none))
    used = F.filter("_blocks", lambda b: b["e"] > b["s"])
    least, most = F.array_min(F.transform(used, lambda b: b["s"])), F.array_max(F.transform(used, lambda b: b["e"]))
    df = df.withColumn("_at", F.when(F.col("ref").isNotNull(), _cell(F.greatest(least, F.lit(0)), F.greatest(most, F.lit(1)))))
    df = df.withColumns({"_ref": F.when(F.col("_at").isNotNull(), F.col("ref")), "_bits": F.col("_at.bits"), "_cell": F.col("_at.cell")})
    cells = df.where("_cell is not null").groupBy("_ref", "_bits", "_cell").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("_parts")).persist()
    table = F.broadcast(cells) if cells.limit(BROADCAST_REGIONS + 1).count() <= BROADCAST_REGIONS else cells
    same = ["_ref", "_bits", "_cell"]
    told = ["ord"] if "ord" in columns else ["pos", "cigar", "flag"]
    dealt = F.pmod(F.xxhash64(*told), F.coalesce("_parts", F.lit(1 << 20))).cast("int")  # reads without a cell go anywhere
    payload = F.struct(*(F.col(f"`{c}`") for c in columns), F.col("ref").alias("_own_ref"), R.is_reverse(F.col("flag")).alias("_rev"), F.col("_blocks"))
    left = df.join(table, same, "left").select(*same, dealt.alias("_salt"), F.lit(1).alias("_kind"), F.lit(None).cast(_REGION).alias("_region"), payload.alias("_read"))
    numbers = F.explode(F.array(*(F.struct(F.lit(bits).alias("bits"), F.sequence(F.shiftright("start", bits), F.shiftright(F.col("end") - 1, bits)).alias("cells")) for bits in LEVELS)))
    g = regions.where("end > start").select(F.struct("ref", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "strand", "id").alias("_region"), F.col("ref").alias("_ref"), numbers.alias("x"))
    g = g.select("_region", "_ref", F.col("x.bits").alias("_bits"), F.explode(F.col("x.cells").cast("array<int>")).alias("_cell")).join(table, same)
    right = g.select(*same, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_salt"), F.lit(0).alias("_kind"), "_region", F.lit(None).cast(left.schema["_read"].dataType).alias("_read"))
    rows = left.unionByName(right).repartition(*_KEY).sortWithinPartitions(*_KEY, "_kind")
    schema = T.StructType([*reads.schema.fields, *(T.StructField(f"hits_{side}", T.ArrayType(T.StringType())) for side in ("correct", "reverse"))])
    return rows.mapInArrow(_sweeper(columns, overlap, multi_region, direction), schema)


def merged(regions: DataFrame) -> DataFrame:
    """Regions (ref, start, end, strand, id) of which those of one id, contig and strand that overlap or touch are one. A read's bases inside
    an id and the ids it meets are the same, since all policies look at the union of an id's regions."""
    each = regions.where("end > start").groupBy("ref", "id", "strand", "start").agg(F.max("end").alias("end"))
    own = Window.partitionBy("ref", "id", "strand").orderBy("start")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    begins = each.withColumn("_new", F.when(before >= F.col("start"), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return begins.groupBy("ref", "id", "strand", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("ref", "start", "end", "strand", "id")


def number(reads: DataFrame):
    """How many reads the rows of a group are."""
    return F.sum("n") if "n" in reads.columns else F.count("*")


def grouped(reads: DataFrame, *keys: str) -> DataFrame:
    """Reads (ref, flag, cigar, pos, status) of equal strand and alignment as one row with their number ``n``, to be matched once; those with a status
    are told by it alone. ``keys`` are told apart, too."""
    live = F.col("status").isNull()
    only = lambda c: F.when(live, c)
    columns = ("status", only(F.col("ref")).alias("ref"), only(F.col("flag").bitwiseAND(16)).alias("flag"), only(F.col("pos")).alias("pos"), only(F.col("cigar")).alias("cigar"))
    own = ["n"] if "n" in reads.columns else []
    return reads.select(*keys, *columns, *own).groupBy(*keys, "status", "ref", "flag", "pos", "cigar").agg(number(reads).alias("n"))


def broadcastable(table: DataFrame, most: int = BROADCAST_REGIONS) -> bool:
    """Whether merged regions are few enough to be sent to the tasks."""
    n, size = table.agg(F.count("*"), F.sum(F.octet_length("id") + F.octet_length("ref"))).first()
    return n <= most and (size or 0) <= BROADCAST_BYTES


def by_regions(reads: DataFrame, regions: DataFrame, overlap: str = "union", multi_region: str = "count_both", direction: str = "forward", most: int = BROADCAST_REGIONS) -> DataFrame:
    """Adds hits_correct, hits_reverse to reads (ref, flag, cigar, pos, status, and ord but for grouped ones); reads with a status get none."""
    live = F.col("status").isNull()
    blocks = R.blocks(F.col("cigar"), F.col("pos"))
    table = merged(regions).persist()  # merged once to be counted and used
    if broadcastable(table, most):
        index = reads.sparkSession.sparkContext.broadcast(RegionIndex(table.toArrow()))
        table.unpersist()
        match = F.arrow_udf(_matcher(index, overlap, multi_region, direction), HITS)
        found = reads.withColumn("_hits", match("ref", R.is_reverse(F.col("flag")), F.when(live, blocks).otherwise(F.array().cast("array<struct<s:int,e:int>>"))))
        return found.withColumns({"hits_correct": F.col("_hits.correct"), "hits_reverse": F.col("_hits.reverse")}).drop("_hits")
    return swept(reads, table, overlap, multi_region, direction)


def _one(reads: DataFrame, side, name) -> DataFrame:
    """One hit for each read without a status, where ``name`` is not null."""
    at = lambda s: F.when(F.col("status").isNull() & name.isNotNull() & (side == s), F.array(name)).otherwise(F.array().cast("array<string>"))
    return reads.withColumns({"hits_correct": at("correct"), "hits_reverse": at("reverse")})


def by_reference(reads: DataFrame, direction: str) -> DataFrame:
    """Each read hits its contig; contigs count as forward regions."""
    return _one(reads, R.side(direction, R.is_reverse(F.col("flag")), F.lit("+")), F.col("ref"))


def by_tag(reads: DataFrame, tag: str) -> DataFrame:
    """Each read hits the region that a string tag names; without one there is no hit."""
    t = R.tag(tag)
    return _one(reads, F.lit("correct"), F.when(t["t"] == "Z", t["v"]))


def hits(matched: DataFrame, *carried: str) -> DataFrame:
    """The lists as rows: the carried columns, side, id."""

    def rows(side: str):
        return F.transform(f"hits_{side}", lambda x: F.struct(F.lit(side).alias("side"), x.alias("id")))

    return matched.select(*carried, F.inline(F.concat(rows("correct"), rows("reverse"))))
