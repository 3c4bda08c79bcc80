"""GTF / GFF3 annotation and barcode whitelists."""

from __future__ import annotations

import gzip
import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# How compressed files begin.
GZIP, ZSTD = b"\x1f\x8b", b"\x28\xb5\x2f\xfd"


def _unpacked(batches: Iterator, chunk: int = 1 << 20) -> Iterator:
    """Lines of compressed files, a file at a time, decompressed as they are read."""
    import pyarrow as pa
    import zstandard

    def lines(content: bytes) -> Iterator[str]:
        raw = pa.BufferReader(content)
        stream = gzip.GzipFile(fileobj=raw) if content[:2] == GZIP else zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
        rest = b""
        while piece := stream.read(chunk):
            *whole, rest = (rest + piece).split(b"\n")
            yield from (x.rstrip(b"\r").decode() for x in whole)
        if rest:
            yield rest.rstrip(b"\r").decode()

    for batch in batches:
        for content in batch.column("content").to_pylist():
            some = []
            for line in lines(content):
                some.append(line)
                if len(some) == 10_000:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(some, pa.string())})
                    some = []
            yield pa.RecordBatch.from_pydict({"value": pa.array(some, pa.string())})


def _head(spark: SparkSession, path: str, n: int = 4) -> bytes:
    """First bytes of a file, in any store that Spark reads; none of a folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(where).isDirectory():
        return b""
    stream = files.open(where)
    try:
        return bytes(b for b in (stream.read() for _ in range(n)) if b >= 0)
    finally:
        stream.close()


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file (column value). Gzip and zstd are told by the first bytes, whatever the file is called."""
    head = _head(spark, path)
    if head == ZSTD or (head[:2] == GZIP and not path.endswith(".gz")):
        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_unpacked, "value string")
    return spark.read.text(path)


def gtf(spark: SparkSession, path: str, feature: str, attributes: list[str], subformat: str = "auto_detect") -> DataFrame:
    """Rows of one feature: ord, ref, start (0-based), end, strand (+, -, .), attrs (accepted keys only).

    Comments and blank lines are skipped, rows without any accepted key too. A bad number, start or strand, a missing
    field, an accepted key without value or a repeated one aborts. Of a value the blanks behind it and quotes at its ends go. The first accepted row decides between GTF and GFF unless told. A warning
    tells how many rows of the feature have no accepted key.
    """
    lines = text_lines(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).withColumn("ord", F.monotonically_increasing_id())
    f = F.split("value", "\t")
    rows = lines.select("ord", f.alias("f")).where(F.try_element_at("f", F.lit(3)) == feature)
    if subformat == "auto_detect":
        first = rows.select(F.try_element_at("f", F.lit(9))).first()
        subformat = "gff" if first and first[0] and "=" in first[0] else "gtf"
    sep = "=" if subformat == "gff" else " "
    stop = lambda text, kind: F.raise_error(F.lit(text)).cast(kind)
    number = lambda i, what: F.coalesce(F.col("f")[i].try_cast("long"), stop(f"{what} is no number", "long"))
    whole = F.when(F.size("f") >= 9, F.col("f")).otherwise(stop("a field is missing", "array<string>"))
    rows = rows.select("ord", whole.alias("f"))
    strand = F.col("f")[6]
    pairs = F.transform(F.split(F.col("f")[8], ";"), lambda x: F.split(F.ltrim(x), sep, 2))
    value = lambda p: F.coalesce(F.btrim(F.rtrim(F.try_element_at(p, F.lit(2))), F.lit('"')), stop("an attribute has no value", "string"))
    kept = F.transform(F.filter(pairs, lambda p: p[0].isin(*attributes)), lambda p: F.struct(p[0].alias("k"), value(p).alias("v")))
    out = rows.select(
        "ord", F.col("f")[0].alias("ref"),
        F.when(number(3, "start") > 0, number(3, "start") - 1).otherwise(stop("start must be positive", "long")).cast("int").alias("start"),
        number(4, "end").cast("int").alias("end"),
        F.when(strand.isin("+", "-"), strand).when(strand.isin(".", "_"), ".").otherwise(stop("unknown strand", "string")).alias("strand"),
        F.map_from_entries(kept).alias("attrs"),
    )
    if without := out.where(F.size("attrs") == 0).count():
        warnings.warn(f"{without} rows of feature {feature} have none of the attributes {', '.join(attributes)} and are skipped", stacklevel=2)
    return out.where(F.size("attrs") > 0)


def numbered(rows: DataFrame) -> DataFrame:
    """``ord`` becomes the row number from 0 in file order: numbers inside the file's splits, to which the sizes of the
    earlier splits are added (a row per split passes the driver)."""
    rows = rows.withColumn("_split", F.shiftright("ord", 33).cast("int"))
    sizes = sorted(tuple(r) for r in rows.groupBy("_split").count().collect())
    before = [(k, sum(n for _, n in sizes[:i])) for i, (k, _) in enumerate(sizes)]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "_split int, _before long"))
    at = F.row_number().over(Window.partitionBy("_split").orderBy("ord"))
    return rows.withColumn("_at", at).join(offsets, "_split").withColumn("ord", F.col("_before") + F.col("_at") - 1).drop("_split", "_at", "_before")


def regions(entries: DataFrame, id_attribute: str, aggr_attribute: str | None = None) -> DataFrame:
    """(ord, ref, start, end, strand, id, aggr); a row without the id attribute aborts."""
    need = lambda k: F.coalesce(F.try_element_at("attrs", F.lit(k)), F.raise_error(F.lit(f"attribute {k} is missing")).cast("string"))
    return entries.select("ord", "ref", "start", "end", "strand", need(id_attribute).alias("id"), need(aggr_attribute or id_attribute).alias("aggr"))


def whitelist(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """segment (number of the file), entry (trimmed line)."""
    out = None
    for i, path in enumerate(paths):
        one = text_lines(spark, path).select(F.lit(i).alias("segment"), F.trim("value").alias("entry")).distinct()
        out = one if out is None else out.unionByName(one)
    return out
