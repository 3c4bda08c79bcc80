"""Results as files: TSV tables, statistics, a MatrixMarket triple and annotated BAM. Each is one file by definition. Tables of
one row per region or statistic are streamed through the driver partition by partition; matrix entries and
BAM records are written as parts by tasks, and copied to their places in the file by tasks."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from readtally.config import Config
from readtally.operators import counts
from readtally.plans import quantify
from readtally.sources import bam, stores


def _lines(path: str, rows, header: list[str] = ()) -> None:
    with stores.open_output(path) as f:
        for row in ([header] if header else []):
            f.write(("\t".join(row) + "\n").encode())
        for row in rows:
            f.write(("\t".join(str(x) for x in row) + "\n").encode())


def matrix(hits: DataFrame, keys: DataFrame) -> tuple[counts.Dictionary, counts.Dictionary, DataFrame]:
    """Features and barcodes (name, index), and entries (feature, barcode, value), 1-based, in order."""
    cells = counts.by_cell(hits)
    features = counts.dictionary(keys.select(F.col("id").alias("feature")), "feature")
    barcodes = counts.dictionary(cells.select("barcode"), "barcode")
    out = cells.join(features.table, cells["id"] == features.table["feature"]).select("barcode", F.col("index").alias("f"), "count").join(barcodes.table, "barcode")
    entries = out.select(F.col("f").alias("feature_index"), F.col("index").alias("barcode_index"), "count")
    return features, barcodes, entries.orderBy("feature_index", "barcode_index")


def _matrix_file(entries: DataFrame, path: str, n_features: int, n_barcodes: int) -> None:
    """The entries as text parts, which tasks copy behind the size line, since that needs their number."""
    folder, seen = f"{path}.parts", Observation()
    entries.select(F.concat_ws(" ", *entries.columns).alias("value")).observe(seen, F.count("*").alias("n")).write.text(stores.uri(folder))
    head = f"%%MatrixMarket matrix coordinate integer general\n%\n{n_features} {n_barcodes} {seen.get['n']}\n".encode()
    stores.join(entries.sparkSession, path, head, [(p, n) for p, n in stores.files(folder) if p.rsplit("/", 1)[-1].startswith("part-")])
    stores.remove_folder(folder)


def write(spark, config: Config) -> None:
    """Runs the configuration. Its files are made in a staging folder and get their names in ``config.directory`` when all are done;
    a run that fails leaves none."""
    folder = config.directory.rstrip("/")
    stage = f"{folder}.staging-{uuid.uuid4().hex}"
    stores.make_folder(stage)
    try:
        result = quantify.run(spark, config)
        try:
            _write(spark, config, result, stage)
        finally:
            result.release()
        stores.make_folder(folder)
        for path, _ in stores.files(stage):
            stores.move(path, f"{folder}/{path.rsplit('/', 1)[-1]}")
    finally:
        stores.remove_folder(stage)


def _write(spark, config: Config, result: quantify.Result, folder: str) -> None:
    _lines(f"{folder}/{'stats.tsv' if config.barcodes else 'counts.tsv.stats.tsv'}", counts.by_status(quantify.with_status(result.groups)).toLocalIterator(), ["stat", "count"])
    if config.barcodes:
        features, barcodes, entries = matrix(result.hits, result.keys)
        try:
            for file, table, name in (("features.tsv", features, "feature"), ("barcodes.tsv", barcodes, "barcode")):
                _lines(f"{folder}/{file}", table.table.orderBy("index").select(name).toLocalIterator())
            _matrix_file(entries, f"{folder}/matrix.mtx", features.size, barcodes.size)
        finally:
            features.release()
            barcodes.release()
    else:
        table = counts.by_region(result.hits, result.keys)
        if config.source.mode == "bam_references":
            table = table.join(bam.contigs(spark, config.bam).select(F.col("name").alias("id"), "tid"), "id").orderBy("tid").drop("tid")
        else:
            table = table.orderBy("id")
        one = config.only_correct or config.strategy.direction == "ignore"
        columns = [result.header, *(["count"] if one else ["count_correct", "count_reverse"])]
        _lines(f"{folder}/counts.tsv", (table.drop("count_reverse") if one else table).toLocalIterator(), columns)
    if config.write_annotated_bam:
        # records keep their bytes but for tags, so they are read where they are written, and rows are their places and tags
        rows, path, text, refs = quantify.annotation_tags(quantify.with_status(result.reads), config), f"{folder}/annotated.bam", bam.header_bytes(config.bam), bam.header(config.bam)[1]
        if result.in_file_order():
            bam.save(rows, path, text, refs, (), config.bam)
            return
        if "ords" in rows.columns:
            rows = rows.withColumn("ord", F.explode("ords")).drop("ords")
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)  # read once for the ranges and once to be sorted
        try:
            bam.save(rows, path, text, refs, ("tid", "ord"), config.bam)
        finally:
            rows.unpersist()
