"""The quantification: reads to statuses, hits and counts."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readtally.config import Config
from readtally.functions import reads as R
from readtally.operators import barcodes, counts, dedup, filters, match, regions
from readtally.sources import annotation, bam


@dataclass
class Result:
    scanned: DataFrame  # annotated reads
    table: DataFrame | None  # regions
    config: Config
    groups: DataFrame  # matched groups of reads with their number n
    hits: DataFrame  # barcode, side, id, n of counted reads
    keys: DataFrame  # id of all regions
    header: str  # name of the id column
    merged: DataFrame | None = None  # regions of an annotated BAM, whose reads are matched, too, and its reads where ``_alike`` takes them together
    places: DataFrame | None = None

    @cached_property
    def reads(self) -> DataFrame:
        """Every read with status (null where counted), corrected position, umi, barcode, hits_correct, hits_reverse; computed anew where used.
        Reads that ``_alike`` takes together are one row, with their number ``n`` or places ``ords``."""
        return matched(self.scanned, self.config, self.table if self.merged is None else self.merged)

    def in_file_order(self) -> bool:
        """Whether ``reads`` come as in the file: nothing between scan and result shuffles them."""
        plain = self.config.dedup_mode == "none" and not (self.config.barcodes and self.config.barcodes.whitelist_files)
        return plain and (self.config.source.mode != "gtf" or match.broadcastable(match.merged(self.table) if self.merged is None else self.merged))

    def release(self) -> None:
        self.groups.unpersist()
        for kept in (self.table, self.merged, self.places):
            if kept is not None:
                kept.unpersist()


def annotated(reads: DataFrame, config: Config, whitelist: DataFrame | None = None, order: tuple[str, ...] = ("ord",), reach: int | None = None) -> DataFrame:
    """Adds corrected, raw_barcode, barcode, umi and status; status is null where the read counts.

    A read keeps the first reason: filtered, no_barcode, barcode_not_in_whitelist, no_umi, filtered (by UMI), duplicate. ``reach``: the
    partitions hold whole buckets of reads that begin so far behind them, and duplicates are found inside them.
    """
    pos = R.corrected_position(F.col("cigar"), F.col("pos"), config.max_skip_length) if config.correct_clipping else F.col("pos")
    none = F.lit(None).cast("string")
    early = any(f["mode"] in filters.BEFORE for f in config.filters)
    dropped = filters.any_removes(config.filters, filters.BEFORE) if early else F.lit(False)
    df = reads.withColumn("corrected", pos).withColumn("_out", dropped)
    reasons = [F.when(F.col("_out"), "filtered")]
    if config.barcodes:
        # what a filtered read lacks is not extracted, so it cannot abort the run
        df = df.withColumn("raw_barcode", F.when(~F.col("_out"), R.extractor(config.barcodes.extract)))
        df = barcodes.correct(df, whitelist, config.barcodes.separator, config.barcodes.max_hamming, len(config.barcodes.whitelist_files) or None)
        reasons += [F.when(F.col("raw_barcode").isNull(), "no_barcode"), F.when(F.col("barcode").isNull(), "barcode_not_in_whitelist")]
    else:
        df = df.withColumns({"raw_barcode": none, "barcode": none})
    if config.umi:
        wanted = ~F.col("_out") & (F.col("barcode").isNotNull() if config.barcodes else F.lit(True))
        df = df.withColumn("umi", F.when(wanted, R.extractor(config.umi)))
        reasons.append(F.when(F.col("umi").isNull(), "no_umi"))
    else:
        df = df.withColumn("umi", none)
    if any(f["mode"] in filters.AFTER for f in config.filters):
        reasons.append(F.when(filters.any_removes(config.filters, filters.AFTER), "filtered"))
    df = df.withColumn("status", F.coalesce(*reasons, none)).drop("_out")
    if reach is not None:
        return dedup.mark_inside_partitions(df, config.dedup_mode, reach)
    bucket = F.col("corrected") if config.dedup_bucket == "per_position" else None
    return dedup.mark_duplicates(df, config.dedup_mode, bucket, list(order))


def matched(df: DataFrame, config: Config, region_table: DataFrame | None) -> DataFrame:
    """Adds hits_correct, hits_reverse; only reads without a status meet the regions, since no filter looks at hits."""
    if config.source.mode == "gtf":
        s = config.strategy
        return match.by_regions(df, region_table, s.overlap, s.multi_region, s.direction)
    if config.source.mode == "bam_references":
        return match.by_reference(df, config.strategy.direction)
    return match.by_tag(df, config.source.tag)


def counted(df: DataFrame, config: Config, region_table: DataFrame | None) -> DataFrame:
    """Annotated reads as matched groups with their number ``n``, for counts: reads of one alignment (and cell) meet the regions once."""
    if config.source.mode == "gtf":
        return matched(match.grouped(df, "barcode"), config, region_table)
    hits = ("status", "barcode", "hits_correct", "hits_reverse")
    return matched(df, config, None).groupBy(*hits).agg(match.number(df).alias("n"))


def with_status(df: DataFrame) -> DataFrame:
    """Final statuses of matched reads."""
    return df.withColumn("status", counts.final_status(F.col("status"), F.size("hits_correct"), F.size("hits_reverse")))


def annotation_tags(df: DataFrame, config: Config) -> DataFrame:
    """The places of reads with final statuses, and the tags XF, XQ, XR, XP, CB and CR as columns for ``bam.save``, null without a value."""
    done = F.col("status").isin("correct", "reverse", "ambiguous", "outside")
    code = {"filtered": 1, "duplicate": 3, "barcode_not_in_whitelist": 4, "no_barcode": 5, "no_umi": 6}
    joined = lambda s: F.when(done, F.array_join(f"hits_{s}", ","))
    tags = {
        "XF:C": F.coalesce(*[F.when(F.col("status") == k, v) for k, v in code.items()]), "XQ:Z": joined("correct"), "XR:Z": joined("reverse"),
        "XP:i": F.when(done, F.col("corrected") + 1), "CB:Z": F.when(done, F.col("barcode")),
    }
    if config.barcodes:
        tags["CR:Z"] = F.when(F.col("status") == "barcode_not_in_whitelist", F.col("raw_barcode"))
    return df.select("tid", "ords" if "ords" in df.columns else "ord", *(value.alias(name) for name, value in tags.items()))


def _table(spark: SparkSession, config: Config) -> DataFrame:
    s = config.source
    entries = annotation.gtf(spark, s.filename, s.feature, sorted({s.id_attribute, s.aggr_id_attribute}), s.subformat)
    if entries.isEmpty():
        raise ValueError(f"No GTF entries found for feature {s.feature}. Perhaps set subformat to GFF/GTF?")
    table = annotation.regions(entries, s.id_attribute, s.aggr_id_attribute)
    return regions.rename(annotation.numbered(table)) if s.duplicate_handling == "rename" else regions.collapse(table)


def _modes(config: Config) -> set[str]:
    return {e["mode"] for e in (config.umi, config.barcodes.extract if config.barcodes else None) if e}


def _alike(config: Config) -> bool:
    """Whether nothing tells reads that agree in position, strand, CIGAR and tags, so that the scan takes them together."""
    return config.dedup_mode == "none" and not _modes(config) - {"tag"}


def _columns(config: Config, places: bool) -> list[str]:
    """Columns of the scan that the configuration needs. ``places``: with those of the records in the file."""
    modes = _modes(config)
    tags = "tag" in modes or config.dedup_mode != "none" or config.source.mode == "bam_tag" or any(f["mode"] == "multimapper" for f in config.filters)
    wanted = {"qname": modes & {"regex_name", "search_in_name"}, "seq": "read_region" in modes, "tags": tags}
    own = [c for c in ("ord", "qname", "flag", "tid", "ref", "pos", "mapq", "cigar", "seq", "tags") if wanted.get(c, True)]
    return [*(c for c in own if c not in ("ord", "mapq")), "ords" if places else "n"] if _alike(config) else own


def _tags(config: Config) -> list[str]:
    """Tags that the configuration reads."""
    named = [e["tag"] for e in (config.umi, config.barcodes.extract if config.barcodes else None) if e and e["mode"] == "tag"]
    return sorted({"NH", *named, *([config.source.tag] if config.source.mode == "bam_tag" else [])})


def _scanned(spark: SparkSession, config: Config, contigs: list[str], lists: DataFrame | None, places: bool = False) -> DataFrame:
    """The annotated reads of the file, with their places if ``places`` are asked for. Duplicates by position are found inside the scan's partitions, but for very deep loci, each of
    which is a large partition; a whitelist is met in a join, behind which partitions are others."""

    def load(**options) -> DataFrame:
        reader = spark.read.format("bam").option("references", json.dumps(contigs)).option("columns", json.dumps(_columns(config, places)))
        return filters.by_reference(reader.option("tags", json.dumps(_tags(config))).options(**options).load(config.bam), config.filters)

    if config.dedup_mode == "none" or config.dedup_bucket != "per_position" or lists is not None:
        return annotated(load(), config, lists)
    reach = config.max_skip_length if config.correct_clipping else 0
    whole = {"buckets": reach, "clipped": str(config.correct_clipping).lower()}
    out = annotated(load(**whole, spans="small"), config, lists, reach=reach)
    if bam.has_large_spans(config.bam, contigs, **whole):
        out = out.unionByName(annotated(load(**whole, spans="large"), config, lists))
    return out


def run(spark: SparkSession, config: Config) -> Result:
    """Regions and groups of the result are kept in memory and on disk; release it when done."""
    bam.register(spark)
    refs = bam.contigs(spark, config.bam)
    table = None
    scanned = bam.contigs_with_reads(config.bam)
    if config.source.mode == "gtf":
        table = _table(spark, config).persist(StorageLevel.MEMORY_AND_DISK)
        # at most the header's contigs
        known = {r[0] for r in table.select("ref").distinct().join(F.broadcast(refs.select(F.col("name").alias("ref"))), "ref", "left_semi").collect()}
        scanned = [c for c in scanned if c in known]
        keys, name = table.select("id").distinct(), config.source.aggr_id_attribute
    elif config.source.mode == "bam_references":
        keys, name = refs.select(F.col("name").alias("id")), "reference"
    else:
        keys, name = None, config.source.tag
    if not scanned:
        raise ValueError("No chunks generated. This might be because the BAM file is empty or the matcher did not find any regions to quantify.")
    scanned = filters.references(scanned, config.filters, [r[0] for r in refs.select("name").collect()])
    lists = annotation.whitelist(spark, config.barcodes.whitelist_files) if config.barcodes else None
    reads, marked = _scanned(spark, config, scanned, lists, places=config.write_annotated_bam), table
    by_aggregate = table is not None and config.source.aggr_id_attribute != config.source.id_attribute
    if by_aggregate:  # matched by id, reported by aggregate
        names = table.select("id", "aggr").distinct()
        keys = table.select(F.col("aggr").alias("id")).distinct()
    # a read that meets any id of an aggregate meets it, so ids need not be told apart where none excludes another
    early = by_aggregate and (config.strategy.overlap, config.strategy.multi_region) == ("union", "count_both")
    if early:
        marked = table.drop("aggr").join(names, "id").withColumn("id", F.col("aggr"))
    merged = None
    if config.write_annotated_bam and table is not None:  # merged once for groups and reads
        merged = match.merged(table).persist(StorageLevel.MEMORY_AND_DISK)
        marked = merged if marked is table else marked
    each, places = reads, None
    if config.write_annotated_bam and _alike(config):  # few rows, scanned once for groups and reads
        reads = places = reads.persist(StorageLevel.MEMORY_AND_DISK)
        each = reads.withColumn("n", F.size("ords").cast("long"))
    elif config.write_annotated_bam:
        each = _scanned(spark, config, scanned, lists)
    groups = counted(each, config, marked).persist(StorageLevel.MEMORY_AND_DISK)
    hits = match.hits(groups, "barcode", "n")
    if by_aggregate and not early:
        own = ("barcode", "ref", "flag", "pos", "cigar", "n")
        hits = match.hits(groups, *own).join(names, "id").select(*own, "side", F.col("aggr").alias("id")).distinct().select("barcode", "side", "id", "n")
    return Result(reads, table, config, groups, hits, keys if keys is not None else hits.select("id").distinct(), name, merged, places)
