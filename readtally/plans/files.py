"""Queries through files: the synthetic reads and regions are written in the formats of the tool, read back or run through
a whole quantification, and compared with the same SQL as the queries on tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readtally import config
from readtally.functions import reads as R
from readtally.plans import queries as Q
from readtally.sources import annotation, bam, sinks, stores

CONTIGS = [(f"chr{i}", 30_000) for i in range(5)]


def bam_file(spark: SparkSession, sf_dir: str, ties: bool = True) -> str:
    """The synthetic reads as a BAM file, sorted by contig and position; ``ties`` as in ``sorted_reads``."""
    path = f"{stores.scratch(spark)}/reads.bam"
    bam.register(spark)
    bam.save(Q.sorted_reads(spark, sf_dir, ties, text=True).drop("ref"), path, b"@HD\tVN:1.6\tSO:coordinate\n", CONTIGS, ())
    return path


def _aggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads are matched to parts of a gene, counts are the gene's."""
    source = {**_gtf(spark, sf_dir), "id_attribute": "part_id", "aggr_id_attribute": "gene_id"}
    out = _run(spark, sf_dir, source=source, strategy={"overlap": "union", "multi_region": "count_both"})
    return _table(spark, f"{out}/counts.tsv", "id string, count_correct long, count_reverse long")


def annotation_file(spark: SparkSession, sf_dir: str, style: str) -> str:
    """The synthetic regions as a folder of GTF or GFF lines, with rows of another feature between them."""
    path = f"{stores.scratch(spark)}/regions.{style}"
    attributes = 'gene_id "{}"; part_id "{}"; other "x";' if style == "gtf" else "gene_id={};part_id={};other=x"
    before, between, after = attributes.split("{}")
    g = Q.region_table(spark, sf_dir).withColumn("feature", F.explode(F.array(F.lit("exon"), F.lit("gene"))))
    fields = ("ref", F.lit("x"), "feature", F.col("start") + 1, "end", F.lit("."), "strand", F.lit("."), F.concat(F.lit(before), "id", F.lit(between), "ord", F.lit(after)))
    g.select(F.concat_ws("\t", *fields).alias("value")).write.text(path)
    return path


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["ref", "tid", "flag", "qname", "seq", "pos", "mapq", "cigar", "tags"]
    df = bam.scan(spark, bam_file(spark, sf_dir), columns=columns, tags=json.dumps(["CB", "NH"]))
    bases = R.total_length(R.blocks(F.col("cigar"), F.col("pos")))
    return df.groupBy("ref", "tid", "flag", "qname", "seq", R.tag("CB")["v"].alias("cell")).agg(
        F.count("*").alias("count"), F.sum("pos").alias("pos"), F.sum("mapq").alias("mapq"), F.sum(R.hits_number()).alias("nh"), F.sum(bases).alias("bases")
    )


def _ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters that the scan evaluates itself."""
    df = spark.read.format("bam").option("split", 1 << 18).option("pushdown", "true").load(bam_file(spark, sf_dir))
    some = df.where("ref = 'chr1' and pos between 5000 and 9000").where("mapq >= 20 and flag in (64, 80, 128)")
    return some.groupBy("ref", "pos", "flag").agg(F.count("*").alias("count"), F.sum("mapq").alias("mapq"))


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by tests that the scan is given."""
    tests = [("ref", "=", "chr1"), ("pos", ">=", 5000), ("pos", "<=", 9000), ("mapq", ">=", 20), ("flag", "in", [64, 80, 128])]
    df = bam.scan(spark, bam_file(spark, sf_dir), tests, ["ref", "pos", "flag", "mapq"])
    return df.groupBy("ref", "pos", "flag").agg(F.count("*").alias("count"), F.sum("mapq").alias("mapq"))


def _contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bam_file(spark, sf_dir)
    return bam.contigs(spark, path).where(F.col("name").isin(bam.contigs_with_reads(path)))


def _some_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.format("bam").option("references", json.dumps(["chr1", "chr3"])).option("raw", "false").load(bam_file(spark, sf_dir))
    return df.groupBy("ref").agg(F.count("*").alias("count"))


def _regions(style: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        entries = annotation.gtf(spark, annotation_file(spark, sf_dir, style), "exon", ["gene_id"])
        return annotation.regions(entries, "gene_id").select("ref", "start", "end", "strand", "id")

    return query


def _whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two pieces of the reads' barcodes as lists, with blanks around the entries, which repeat."""
    folder, cell = stores.scratch(spark), F.split(R.tag("CB")["v"], "_")
    paths = [f"{folder}/list{i}" for i in range(2)]
    for i, path in enumerate(paths):
        Q.reads(spark, sf_dir).select(F.concat(F.lit(" "), cell[i], F.lit(" ")).alias("value")).write.text(path)
    return annotation.whitelist(spark, paths)


def _run(spark: SparkSession, sf_dir: str, **settings) -> str:
    """Runs a configuration on the BAM file and returns the folder of its results."""
    out = f"{stores.scratch(spark)}/out"
    box = {"bam": bam_file(spark, sf_dir, settings.pop("ties", True)), "source": settings.pop("source")}
    sinks.write(spark, config.from_dict({"input": box, "dedup": settings.pop("dedup", {"mode": "none"}), "output": {"directory": out, **settings.pop("output", {})}, **settings}))
    return out


def _gtf(spark: SparkSession, sf_dir: str) -> dict:
    """Without collapsing: equal regions of a gene are one region anyway."""
    return {"mode": "gtf", "filename": annotation_file(spark, sf_dir, "gtf"), "feature": "exon", "id_attribute": "gene_id"}


def _deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates by position are found inside the scan's partitions."""
    out = _run(spark, sf_dir, source=_gtf(spark, sf_dir), umi=_TAG_UMI, dedup={"mode": "Umi"}, strategy={"multi_region": "drop"})
    return _table(spark, f"{out}/counts.tsv", "id string, count_correct long, count_reverse long")


def _table(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep="\t", header=header)


def _counts(overlap: str, multi: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _run(spark, sf_dir, source=_gtf(spark, sf_dir), strategy={"overlap": overlap, "multi_region": multi})
        return _table(spark, f"{out}/counts.tsv", "id string, count_correct long, count_reverse long")

    return query


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(spark, sf_dir, source=_gtf(spark, sf_dir), filter=[{"mode": "MultiMapper", "action": "remove"}])
    return _table(spark, f"{out}/counts.tsv.stats.tsv", "stat string, count long")


_TAG_UMI = {"mode": "BamTag", "tag": "UB"}


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = {"extract": {"mode": "BamTag", "tag": "CB"}, "separator_char": "_"}
    out = _run(spark, sf_dir, source={"mode": "bam_tag", "tag": "XF"}, umi=_TAG_UMI, cell_barcodes=cells, dedup={"mode": "SingleCell", "bucket": "PerReference"})

    def names(file: str, name: str) -> DataFrame:
        """Lines with their numbers, as the matrix counts them."""
        lines = spark.read.text(f"{out}/{file}").select(F.monotonically_increasing_id().alias("ord"), F.col("value").alias(name))
        return annotation.numbered(lines).select((F.col("ord") + 1).alias(f"{name}_index"), name)

    lines = spark.read.text(f"{out}/matrix.mtx").withColumn("ord", F.monotonically_increasing_id())
    size_line = lines.where(~F.col("value").startswith("%")).agg(F.min("ord")).first()[0]
    lines = lines.where(F.col("ord") > size_line).select(F.split("value", " ").cast("array<long>").alias("v"))
    entries = lines.select(*(F.col("v")[i].alias(c) for i, c in enumerate(("f", "b", "count"))))
    full = entries.join(names("features.tsv", "id"), F.col("f") == F.col("id_index")).join(names("barcodes.tsv", "barcode"), F.col("b") == F.col("barcode_index"))
    return full.select("id", "barcode", "count")


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(spark, sf_dir, source=_gtf(spark, sf_dir), filter=[{"mode": "NonPrimary", "action": "remove"}], output={"write_annotated_bam": True}, ties=False)
    df = bam.scan(spark, f"{out}/annotated.bam", columns=["ref", "pos", "tags", "n"], tags=json.dumps(["XF", "XP", "XQ", "XR"]))
    start = R.tag("XP")["v"].cast("long") - F.col("pos")
    return df.groupBy("ref", *(R.tag(name)["v"].alias(name.lower()) for name in ("XF", "XQ", "XR"))).agg(F.sum("n").alias("count"), F.sum(start * F.col("n")).alias("shift"))


def _by_region(sql_of_hits: str) -> str:
    return f"{sql_of_hits} SELECT id, CAST(count(h.ord) FILTER (side = 'correct') AS BIGINT) AS count_correct, CAST(count(h.ord) FILTER (side = 'reverse') AS BIGINT) AS count_reverse FROM (SELECT DISTINCT id FROM g) LEFT JOIN hh h USING (id) GROUP BY id"


QUERIES = {
    "bam_scan_records": _scan,
    "bam_range_scan": _ranged,
    "bam_tested_scan": _tested,
    "bam_contigs": _contigs,
    "bam_reference_scan": _some_contigs,
    "gtf_scan": _regions("gtf"),
    "gff_scan": _regions("gff"),
    "whitelist_scan": _whitelist,
    "run_stats_file": _stats,
    "run_matrix_files": _matrix,
    "run_annotated_bam": _annotated,
}
ORACLES = {
    "bam_scan_records": f"""{Q._B}, t AS (SELECT ord, sum(e - s) AS n FROM r JOIN b ON k = shape GROUP BY ord)
SELECT ref, tid, flag, 'r:UMI_' || u || ':' AS qname, u || 'ACGTACGTACGTACGT' AS seq, b1 || '_' || b2 AS cell, count(*) AS count, CAST(sum(pos) AS BIGINT) AS pos,
       CAST(sum(mapq) AS BIGINT) AS mapq, CAST(sum(nh) AS BIGINT) AS nh, CAST(sum(n) AS BIGINT) AS bases FROM r JOIN t USING (ord) GROUP BY ALL""",
    "bam_range_scan": f"{Q._WITH} SELECT ref, pos, flag, count(*) AS count, CAST(sum(mapq) AS BIGINT) AS mapq FROM r WHERE ref = 'chr1' AND pos BETWEEN 5000 AND 9000 AND mapq >= 20 AND flag IN (64, 80, 128) GROUP BY ALL",
    "bam_contigs": f"{Q._WITH} SELECT DISTINCT tid, ref AS name, CAST(30000 AS BIGINT) AS length FROM r",
    "bam_reference_scan": f"{Q._WITH} SELECT ref, count(*) AS count FROM r WHERE ref IN ('chr1', 'chr3') GROUP BY ref",
    "whitelist_scan": f"{Q._WITH} SELECT DISTINCT 0 AS segment, b1 AS entry FROM r UNION ALL SELECT DISTINCT 1, b2 FROM r",
    "run_stats_file": Q.ORACLES["stats_histogram"],
    "run_matrix_files": Q._M.replace("mapq DESC, ord)", "mapq DESC, pos, ord)") + " SELECT gene AS id, barcode, count(*) AS count FROM x GROUP BY ALL",
    "run_annotated_bam": f"""{Q._HIT} {Q._POLICY['union']}, n AS (SELECT ord, string_agg(id, ',' ORDER BY id) FILTER (side = 'correct') AS q, string_agg(id, ',' ORDER BY id) FILTER (side = 'reverse') AS v FROM h GROUP BY ord),
x AS (SELECT ref, flag & 256 <> 0 AS out_, c.n AS clip, q, v FROM r JOIN c ON k = shape LEFT JOIN n USING (ord))
SELECT ref, CASE WHEN out_ THEN '1' END AS xf, CASE WHEN NOT out_ THEN coalesce(q, '') END AS xq, CASE WHEN NOT out_ THEN coalesce(v, '') END AS xr,
       count(*) AS count, CAST(sum(CASE WHEN NOT out_ THEN 1 - clip END) AS BIGINT) AS shift FROM x GROUP BY ALL""",
}
for style in ("gtf", "gff"):
    ORACLES[f"{style}_scan"] = f'{Q._WITH} SELECT ref, start_ AS start, end_ AS "end", strand, id FROM g'
for overlap, policy in Q._POLICY.items():
    for multi in ("drop", "count_both"):
        keep = "hh AS (SELECT * FROM h)" if multi == "count_both" else "hh AS (SELECT * FROM h QUALIFY count(*) OVER (PARTITION BY ord, side) = 1)"
        QUERIES[f"run_{overlap}_{multi}"] = _counts(overlap, multi)
        ORACLES[f"run_{overlap}_{multi}"] = _by_region(f"{Q._HIT} {policy}, {keep}")
QUERIES["run_union_aggregate"], ORACLES["run_union_aggregate"] = _aggregated, ORACLES["run_union_count_both"]
ORACLES["bam_tested_scan"] = ORACLES["bam_range_scan"]
_FLAGSHIP = Q.ORACLES["flagship_union_drop_umi"].replace("mapq DESC, ord)", "mapq DESC, pos, ord)").rpartition("SELECT")[0]  # ties go by file order
QUERIES["run_dedup_position"], ORACLES["run_dedup_position"] = _deduplicated, _by_region(f"{_FLAGSHIP}, hh AS (SELECT * FROM d)")
