"""Work that must not grow faster than the reads: piled-up regions and reads, files of one deep locus."""

import os
import random

import pytest
from pyspark.sql import functions as F

from readtally.operators import counts, match

READ = "ord long, ref string, flag int, pos int, cigar array<struct<op:string,len:int>>, status string"


def pile(spark, n_reads=300, n_regions=600, seed=3):
    rnd = random.Random(seed)
    reads = [(i, rnd.choice(["a", "b", None]), rnd.choice([0, 16, 64]), rnd.randrange(20), rnd.choice([[("M", 9)], [("M", 3), ("N", 40), ("M", 3)], []]), rnd.choice([None, None, "filtered"])) for i in range(n_reads)]
    regions = []
    for i in range(n_regions):
        s = rnd.randrange(70)
        regions.append((rnd.choice("ab"), s, s + rnd.choice([0, 1, 4, 30]), rnd.choice("+-."), rnd.choice(["x", "y", "z"])))
    return spark.createDataFrame(reads, READ), spark.createDataFrame(regions, "ref string, start int, end int, strand string, id string")


def test_regions_of_an_id_are_merged(spark):
    _, regions = pile(spark)
    got = match.merged(regions).collect()
    want = {}
    for r in regions.collect():
        want.setdefault((r["ref"], r["strand"], r["id"]), set()).update(range(r["start"], r["end"]))
    covered = {}
    for r in got:
        places = covered.setdefault((r["ref"], r["strand"], r["id"]), [])
        places += range(r["start"], r["end"])
    assert {k: sorted(v) for k, v in covered.items()} == {k: sorted(v) for k, v in want.items() if v}
    # touching ones are one
    assert len(got) == sum(1 for v in want.values() for p in v if p - 1 not in v) < regions.count() / 10


def test_groups_count_like_reads(spark):
    reads, regions = pile(spark)
    for most in (match.BROADCAST_REGIONS, 0):
        for overlap, multi in (("union", "count_both"), ("intersection_non_empty", "drop")):
            one, all_ = match.by_regions(match.grouped(reads), regions, overlap, multi, most=most), match.by_regions(reads, regions, overlap, multi, most=most)
            assert one.count() < reads.count() and one.agg(F.sum("n")).first()[0] == reads.count()
            want = {tuple(r) for r in counts.by_region(match.hits(all_)).collect()}
            assert {tuple(r) for r in counts.by_region(match.hits(one, "n")).collect()} == want and want
            final = lambda df: df.withColumn("status", counts.final_status(F.col("status"), F.size("hits_correct"), F.size("hits_reverse")))
            assert [tuple(r) for r in counts.by_status(final(one)).collect()] == [tuple(r) for r in counts.by_status(final(all_)).collect()]


def test_deep_locus_is_read_in_pieces(spark, tmp_path, monkeypatch):
    """One index bin may be many partitions; each record is read once, and duplicates by position are found inside them."""
    from readtally import config
    from readtally.plans import quantify
    from readtally.sources import bam, bam_index

    monkeypatch.setattr(bam_index, "CHUNK", 4000)
    path, plain = str(tmp_path / "a.bam"), {"flag": 0, "tid": 0, "mapq": 9, "cigar": [("M", 9)], "seq": "A" * 9}
    rows = [plain | {"qname": f"r{i}", "pos": i // 40, "tags": {"NH": ("C", "1"), "UB": ("Z", "AC"[i % 2])}} for i in range(12_000)]
    monkeypatch.setattr(bam, "BATCH", 50)
    bam.write(path, [("chr1", 9000)], rows, block=1000)
    found = bam_index.read(path)
    assert len(found.begins(0)) > 10 and len(found.ranges(0, 5, 250)) == 1
    bam.register(spark)
    df = spark.read.format("bam").option("split", 4000).load(path)
    assert df.rdd.getNumPartitions() > 5 and sorted(r[0] for r in df.select("qname").collect()) == sorted(r["qname"] for r in rows)
    got = bam.scan(spark, path, [("pos", ">=", 30), ("pos", "<=", 32)], ["pos"], split=4000).groupBy("pos").count().collect()
    assert sorted(tuple(r) for r in got) == [(30, 40), (31, 40), (32, 40)]
    spans = bam.BamReader({"path": path, "split": 4000, "buckets": 9}, []).partitions()
    assert 2 < len(spans) <= 300 // (bam.WIDE * 9) + 1
    c = config.from_dict({"input": {"bam": path, "max_skip_length": 9, "source": {"mode": "bam_references"}}, "umi": {"mode": "tag", "tag": "UB"}, "dedup": {"mode": "umi"}, "output": {"directory": "x"}})
    inside = quantify.annotated(spark.read.format("bam").option("split", 4000).option("buckets", 9).load(path), c, reach=9)
    assert sorted(tuple(r) for r in inside.groupBy("status").count().collect() if r["status"]) == [("duplicate", 11_400)]
    assert inside.where("status is null").count() == 600


def test_sorted_reads_are_made_behind_the_shuffle(spark):
    """The shuffle by range takes the table's rows, and its sampling makes no read: no digest lies below the exchange."""
    from readtally.plans import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    df = queries.sorted_reads(spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("rangepartitioning")
    assert below and "md5" in above and "md5" not in below
    wide = queries.reads(spark, folder)
    same = wide.select(*df.columns[:8], *(F.col("tags")[c[:2]]["v"].alias(c) for c in df.columns[8:]))
    assert sorted(map(str, df.collect())) == sorted(map(str, same.collect()))
    # file order
    place = queries.READS.replace("FROM lineitem", "FROM {t}")
    ords = spark.sql(f"SELECT tid, pos, ord, concat('r:UMI_', u, ':') AS qname FROM ({place})", t=spark.read.parquet(f"{folder}/lineitem.parquet")).orderBy("tid", "pos", "ord").collect()
    assert [(r["tid"], r["pos"], r["qname"]) for r in df.collect()] == [(r["tid"], r["pos"], r["qname"]) for r in ords]
