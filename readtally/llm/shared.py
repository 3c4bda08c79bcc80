"""What the operators share: row identity, tables in the cluster's shared folder, checked broadcasts, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side made of fixed-width columns is broadcast; beyond, Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000
#: Numbers of 8 bytes that take the room of a narrow row (64 bytes).
ROW_NUMBERS = 8


#: Words of a text column in DuckDB: A-Z lowered, null is empty.
SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary folder is used if
    the master is local (tests on one machine); elsewhere that would lose data, so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: executors share no folder")
    return _own_dir()


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="readtally-")


def stored(df: DataFrame, name: str = "table", codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and a lost executor takes
    nothing along. Columns are kept compact, which ``checkpoint()`` (serialised rows) does not do."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/readtally-{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.compression.codec.zstd.level", "1").parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more. Tables that a result still reads stay until the folder is cleared."""
    for t in tables:
        where = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t._stored_at)
        where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_hash(text: str | Column = "text") -> Column:
    """64-bit hash of the text; null and empty differ by the seed column."""
    c = F.col(text) if isinstance(text, str) else text
    return F.xxhash64(c, c.isNull())


def with_row_key(df: DataFrame) -> DataFrame:
    """Adds ``_k``: struct of doc_id and text hash. Rows with equal keys are the same document repeated; a doc_id that
    comes with two texts is two documents."""
    return df.withColumn("_k", F.struct(F.col("doc_id").cast("long").alias("d"), text_hash().alias("h")))


def small(df: DataFrame, limit: int = BROADCAST_ROWS, array: str | None = None) -> DataFrame:
    """``df`` (a stored table of narrow rows) with a broadcast hint if it has at most ``limit`` rows. ``array``: a column
    of numbers (8 bytes at most), of which ``ROW_NUMBERS`` count as a row more."""
    if df.limit(limit + 1).count() > limit:
        return df
    if array:
        n, inside = df.agg(F.count("*"), F.sum(F.size(array))).first()
        if n + (inside or 0) / ROW_NUMBERS > limit:
            return df
    return F.broadcast(df)


KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def packed(docs: DataFrame) -> DataFrame:
    """Columns beyond those of documents in one struct, so that their names clash with nothing inside an operator."""
    others = [c for c in docs.columns if c not in KNOWN]
    return docs.select(*[c for c in docs.columns if c in KNOWN], F.struct(*[F.col(f"`{c}`") for c in others]).alias("_rt_extra")) if others else docs


def unpacked(out: DataFrame, columns: list[str], *more: str | Column) -> DataFrame:
    """Undoes ``packed``: the original ``columns`` in their order, then ``more`` (which replace columns of their names)."""
    new = {m for m in more if isinstance(m, str)}
    return out.select(*[F.col(c) if c in KNOWN else F.col("_rt_extra")[c].alias(c) for c in columns if c not in new], *more)


def put(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns; existing ones of these names (input columns that clash) are replaced."""
    return df.withColumns(cols)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of ``edges`` (columns a, b): rows (node, label), label = smallest node of the component.

    Alternates large-star and small-star steps; each round is one pair of shuffles on node keys with map-side
    aggregation of the minimum, is written to the shared folder and ends when no edge changed. A hub's neighbours are
    never gathered into one group: the minimum is aggregated and joined back, so a skewed hub can be split. Rounds grow
    with the logarithm of the nodes (a path of 2^20 nodes takes about 20), so ``rounds`` is a guard against a fault, and an error.
    """
    step = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = step.select("u", "v").unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = stored(low, "minima")  # a plain table, so that Spark can split a hub's partition in the join
        # large star: every larger neighbour of u is linked to u's smallest neighbour
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: smaller neighbours of u, and u itself, are linked to the smallest of them
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        new = large.join(small_low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = stored(new.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        # fixed point: every node has one edge and no target has one
        flat = new.agg(F.count("*").alias("n"), F.countDistinct("u").alias("k")).first()
        done = flat["n"] == flat["k"] and new.join(new.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() == 0
        discard(step, low)
        step = new
        if done:
            break
    else:
        raise RuntimeError("components: no fixed point")
    nodes = step.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(step.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
