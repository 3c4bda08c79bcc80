"""Region matching against a plain version, by both ways, and whole runs on a BAM file with an annotation."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from readtally import config
from readtally.functions import reads as R
from readtally.operators import dedup, filters, match, regions
from readtally.plans import quantify
from readtally.sources import annotation, bam, sinks

RNG = random.Random(7)
CIGARS = [[("M", 50)], [("M", 20), ("N", 300), ("M", 30)], [("S", 5), ("M", 40)], [("M", 10), ("D", 5), ("M", 10)], [("M", 10), ("I", 3), ("M", 20)]]
READS = [{"ord": i, "ref": RNG.choice(["a", "b", "zz"]), "flag": RNG.choice([0, 16]), "pos": RNG.randrange(3000), "cigar": RNG.choice(CIGARS)} for i in range(400)]
REGIONS = [(i, RNG.choice(["a", "b"]), s := RNG.randrange(3000), s + RNG.choice([1, 30, 90, 700, 2500]), RNG.choice("+-."), f"g{RNG.randrange(25)}") for i in range(60)]
REGIONS.append((60, "a", 500, 500, "+", "nothing"))


def blocks(pos, cigar):
    out = []
    for op, n in cigar:
        if op == "M":
            out.append((pos, pos + n))
        pos += n if op in "MDN" else 0
    return out


def by_hand(read, overlap, multi, direction):
    want = {p for s, e in blocks(read["pos"], read["cigar"]) for p in range(s, e)}
    met = {"correct": {}, "reverse": {}}
    for _, ref, start, end, strand, name in REGIONS:
        common = want & set(range(start, end)) if ref == read["ref"] else set()
        if common:
            same = bool(read["flag"] & 16) == (strand == "-")
            wrong = direction != "ignore" and strand != "." and (same if direction == "reverse" else not same)
            met["reverse" if wrong else "correct"].setdefault(name, set()).update(common)
    out = []
    for side in ("correct", "reverse"):
        names = {n for n, c in met[side].items() if overlap == "union" or c == want}
        if overlap == "intersection_non_empty" and not names:
            names = set(met[side])
        out.append([] if multi == "drop" and len(names) != 1 else sorted(names))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    reads = spark.createDataFrame([(r["ord"], r["ref"], r["flag"], r["pos"], r["cigar"], "filtered" if r["ord"] == 3 else None) for r in READS], "ord long, ref string, flag int, pos int, cigar array<struct<op:string,len:int>>, status string")
    table = spark.createDataFrame(REGIONS, "ord long, ref string, start int, end int, strand string, id string")
    return reads.repartition(3), table


@pytest.mark.parametrize("overlap", ["union", "intersection_strict", "intersection_non_empty"])
@pytest.mark.parametrize(("multi", "direction"), [("drop", "forward"), ("count_both", "reverse"), ("count_both", "ignore")])
def test_by_regions(tables, monkeypatch, overlap, multi, direction):
    monkeypatch.setattr(match, "PAIRS", 100)
    expected = {r["ord"]: by_hand(r, overlap, multi, direction) if r["ord"] != 3 else [[], []] for r in READS}
    for most in (match.BROADCAST_REGIONS, 0):
        got = match.by_regions(*tables, overlap, multi, direction, most).collect()
        assert {r["ord"]: [r["hits_correct"], r["hits_reverse"]] for r in got} == expected
    assert match.by_regions(tables[0], tables[1].limit(0), overlap, multi, direction).where("size(hits_correct) > 0").count() == 0


def test_crowded_cells(spark, tables, monkeypatch):
    """Reads of one cell in several tasks, cells of several widths, extra columns, and a single shuffle of the reads."""
    far = [{"ord": 1000 + i, "ref": "a", "flag": 0, "pos": (1 << 20) - 20 + i, "cigar": CIGARS[1]} for i in range(30)]
    extra = spark.createDataFrame([(r["ord"], r["ref"], r["flag"], r["pos"], r["cigar"], None) for r in far], tables[0].schema)
    wide = spark.createDataFrame([(500, "a", 0, 1 << 21, "+", "all"), (501, "a", (1 << 20) + 295, (1 << 20) + 305, "-", "edge")], tables[1].schema)
    reads = tables[0].unionByName(extra).withColumn("_kind", F.lit("k")).withColumn("_region", F.lit(5))
    table = tables[1].unionByName(wide)
    want = match.by_regions(reads, table)
    monkeypatch.setattr(match, "CROWD", 7)
    got = match.by_regions(reads, table, most=0)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {i for r in got.where("ord >= 1000").collect() for i in r["hits_correct"]} == {"all"}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def test_duplicates_by_both_ways(spark):
    """The aggregate over whole contigs marks what a window over the same groups marks."""
    rows = [(i, RNG.choice("ab"), RNG.choice([0, 16]), RNG.choice(["AA", "AC", None]), RNG.randrange(3), str(RNG.randrange(1, 400)), "filtered" if i % 9 == 0 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "ord long, ref string, flag int, umi string, mapq int, nh string, status string")
    df = df.withColumn("tags", F.create_map(F.lit("NH"), F.struct(F.lit("S").alias("t"), F.col("nh").alias("v"))))
    a, b = ({r["ord"]: r["status"] for r in dedup.mark_duplicates(df, "umi", bucket, ["ord"]).collect()} for bucket in (None, F.lit(0)))
    # without a UMI a read has a status before; here its group is the null one, which only the window knows
    known = {r[0] for r in rows if r[3] is not None}
    assert {k: v for k, v in a.items() if k in known} == {k: v for k, v in b.items() if k in known} and "duplicate" in a.values()


def test_empty_capture(spark):
    names = ["umi=;", "umi=AC;", "x"]
    df = spark.createDataFrame([(n,) for n in names], "qname string")
    how = config._extractor("umi", {"mode": "RegexName", "regex": "x|umi=(?P<u>[ACGT-]*);"})
    assert [r[0] for r in df.select(R.extractor(how)).collect()] == ["", "AC", None]
    with pytest.raises(Exception, match="does not match"):
        spark.createDataFrame([("y",)], "qname string").select(R.extractor(how)).collect()


def test_signed_hits_number(spark):
    df = spark.createDataFrame([({"NH": ("i", "1")},)], "tags map<string,struct<t:string,v:string>>")
    with pytest.raises(Exception, match="NH tag"):
        df.select(R.hits_number()).collect()


def test_renamed_regions(spark, tmp_path):
    gtf = tmp_path / "a.gtf"
    row = 'chr1\tx\t{}\t{}\t9\t.\t+\t.\tgene_id "g";\n'
    gtf.write_text("".join(row.format(f, s) for f, s in (("gene", 1), ("exon", 1), ("gene", 1), ("exon", 1), ("exon", 2), ("exon", 1))))
    table = annotation.regions(annotation.gtf(spark, str(gtf), "exon", ["gene_id"]), "gene_id")
    assert [r["id"] for r in regions.rename(annotation.numbered(table)).orderBy("ord").collect()] == ["g", "g-1", "g", "g-3"]
    packed = tmp_path / "packed"  # no extension
    packed.write_bytes(gzip.compress(gtf.read_bytes()))
    assert annotation.gtf(spark, str(packed), "exon", ["gene_id"]).count() == 4
    with pytest.warns(UserWarning, match="4 rows of feature exon"):
        assert annotation.gtf(spark, str(gtf), "exon", ["other"]).isEmpty()


def _bam(path, rows):
    plain = {"mapq": 30, "seq": "A" * 50, "tags": {"NH": ("C", "1")}}
    bam.write(path, [("a", 9000), ("b", 9000), ("zz", 9000)], sorted((plain | r for r in rows), key=lambda r: (r["tid"], r["pos"])))


@pytest.mark.parametrize("overlap", ["union", "intersection_strict", "intersection_non_empty"])
@pytest.mark.parametrize("multi", ["drop", "count_both"])
def test_run_with_annotation(spark, tmp_path, overlap, multi):
    path, out, gtf = str(tmp_path / "a.bam"), tmp_path / "out", tmp_path / "a.gtf"
    _bam(path, [{"qname": f"r{r['ord']}", "flag": r["flag"], "tid": ["a", "b", "zz"].index(r["ref"]), "pos": r["pos"], "cigar": r["cigar"]} for r in READS])
    named = [r for r in REGIONS if r[3] > r[2]]
    gtf.write_text("".join(f'{ref}\tx\texon\t{s + 1}\t{e}\t.\t{strand}\t.\tgene_id "{name}";\n' for _, ref, s, e, strand, name in named))
    source = {"mode": "gtf", "filename": str(gtf), "feature": "exon", "id_attribute": "gene_id", "duplicate_handling": "collapse"}
    c = {"input": {"bam": path, "source": source, "correct_reads_for_clipping": False}, "dedup": {"mode": "NoDedup"}, "strategy": {"overlap": overlap, "multi_region": multi}, "output": {"directory": str(out)}}
    sinks.write(spark, config.from_dict(c))
    expected = {n: [0, 0] for *_, n in named}
    for r in READS:
        if r["ref"] != "zz":
            for k, names in enumerate(by_hand(r, overlap, multi, "forward")):
                for n in names:
                    expected[n][k] += 1
    got = [x.split("\t") for x in (out / "counts.tsv").read_text().splitlines()]
    assert got == [["gene_id", "count_correct", "count_reverse"], *([n, *map(str, v)] for n, v in sorted(expected.items()))]
    stats = dict(x.split("\t") for x in (out / "counts.tsv.stats.tsv").read_text().splitlines()[1:])
    assert sum(map(int, stats.values())) == sum(r["ref"] != "zz" for r in READS)
    with pytest.raises(ValueError, match="No GTF entries found for feature gene"):
        sinks.write(spark, config.from_dict(c | {"input": {"bam": path, "source": source | {"feature": "gene"}}}))


def test_reference_filter_prunes_the_scan(spark, tmp_path):
    path = str(tmp_path / "a.bam")
    _bam(path, [{"qname": f"r{r['ord']}", "flag": 0, "tid": ["a", "b", "zz"].index(r["ref"]), "pos": r["pos"], "cigar": r["cigar"]} for r in READS])
    c = {"input": {"bam": path, "source": {"mode": "bam_references"}}, "filter": [{"mode": "Reference", "action": "keep", "references": ["b"]}], "dedup": {"mode": "none"}, "output": {"directory": "x"}}
    result = quantify.run(spark, config.from_dict(c))
    assert {r["ref"] for r in result.reads.collect()} == {"b"}
    result.reads.unpersist()
    assert bam.contigs_with_reads(path) == ["a", "b", "zz"]
    left = filters.references(["a", "b", "zz"], [{"mode": "reference", "action": "remove", "references": ["a"]}], ["a", "b", "zz"])
    assert left == ["b", "zz"] and [p.tid for p in bam.BamReader({"path": path, "references": json.dumps(left)}, []).partitions()] == [1, 2]
    empty = str(tmp_path / "empty.bam")
    _bam(empty, [])
    with pytest.raises(ValueError, match="No chunks generated"):
        quantify.run(spark, config.from_dict(c | {"input": {"bam": empty, "source": {"mode": "bam_references"}}}))


def test_annotated_codes(spark, tmp_path):
    """XF codes, CR and CB of every status; old values of the tags that are set go, other tags stay."""
    path, out, lists = str(tmp_path / "a.bam"), tmp_path / "out", tmp_path / "w.txt"
    lists.write_text("AAAA\n")
    rows = [("AAAA", "AC", 0), ("AAAA", "AC", 0), ("CCCC", "AC", 0), ("AAAT", "NN", 0), ("AAAA", "GG", 256)]
    reads = [{"qname": f"r{i}", "flag": flag, "tid": 0, "pos": 100, "cigar": [("M", 50)], "tags": {"NH": ("C", "1"), "CB": ("Z", cb), "UB": ("Z", ub), "XF": ("Z", "old")}} for i, (cb, ub, flag) in enumerate(rows)]
    _bam(path, reads)
    c = {
        "input": {"bam": path, "source": {"mode": "bam_references"}}, "umi": {"mode": "tag", "tag": "UB"}, "dedup": {"mode": "SingleCell"},
        "cell_barcodes": {"extract": {"mode": "BamTag", "tag": "CB"}, "separator_char": "-", "max_hamming": 1, "whitelist_files": [str(lists)]},
        "filter": [{"mode": "NInUMI", "action": "remove"}, {"mode": "NonPrimary", "action": "remove"}], "output": {"directory": str(out), "write_annotated_bam": True},
    }
    sinks.write(spark, config.from_dict(c))
    got = {r["qname"]: {k: v["v"] for k, v in r["tags"].items()} for r in spark.read.format("bam").load(str(out / "annotated.bam")).collect()}
    counted, twice, unknown, letters, second = (got[f"r{i}"] for i in range(5))
    assert "XF" not in counted and all(x["UB"] == ub for x, (_, ub, _) in zip((counted, twice, unknown, letters, second), rows, strict=True))
    assert counted["XQ"] == "a" and counted["XR"] == "" and counted["XP"] == "101" and counted["CB"] == "AAAA"
    assert twice["XF"] == "3" and unknown["XF"] == "4" and unknown["CR"] == "CCCC" and letters["XF"] == "1" and second["XF"] == "1"
    assert all("XQ" not in x for x in (twice, unknown, letters, second)) and "CB" not in second
