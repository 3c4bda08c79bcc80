"""An annotated BAM: reads alike are one row on their way, records are read where they are written."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readtally import config
from readtally.plans import quantify
from readtally.sources import bam, sinks
from test_bam import CONTIGS, piled, rows

GTF = "".join(f'chr{1 + i % 2}\tx\texon\t{1 + 37 * i}\t{60 + 41 * i}\t.\t{"+-."[i % 3]}\t.\tgene_id "g{i % 7}";\n' for i in range(300))


@pytest.fixture
def pile(tmp_path):
    path = str(tmp_path / "in.bam")
    some = [r | {"tags": r["tags"] | ({"XF": ("Z", "old"), "CR": ("Z", "kept")} if i % 3 else {})} for i, r in enumerate(piled(2000))]
    bam.write(path, CONTIGS, some, block=2000)
    return path


def test_reads_alike_are_one_row(spark, pile):
    for columns, tags in ((["flag", "pos", "ref"], None), (["pos", "cigar", "mapq", "tid"], None), (["pos", "tags"], ["NH"]), (["tags"], ["UB", "CB", "NH"]), (["pos", "tags"], None), (["ref"], None)):
        options = {} if tags is None else {"tags": json.dumps(tags)}
        text = [F.col(c).cast("string").alias(c) for c in columns]
        want = bam.scan(spark, pile, columns=columns, **options).select(*text).groupBy(*columns).agg(F.count("*").alias("n")).collect()
        got = bam.scan(spark, pile, columns=[*columns, "n"], **options)
        assert len(want) <= got.count() <= 2 * len(want)  # each contig is a task
        assert sorted(map(tuple, got.select(*text, "n").groupBy(*columns).agg(F.sum("n")).collect())) == sorted(map(tuple, want))
        # their places are those of the reads
        plain = bam.scan(spark, pile, columns=["ord", *columns], **options).select(*text, "ord").collect()
        each = bam.scan(spark, pile, columns=["ords", *columns], split=4000, **options).select(*text, F.explode("ords").alias("ord")).collect()
        assert sorted(map(tuple, each)) == sorted(map(tuple, plain)) and len(plain) == 2000
    with pytest.raises(Exception, match="not told alike by qname"):
        bam.scan(spark, pile, columns=["qname", "n"]).collect()


def test_records_are_read_where_they_are_written(tmp_path, monkeypatch):
    """Tags of rows in small batches, each with several places, against records edited one by one; stretches end inside records."""
    path, rnd = str(tmp_path / "in.bam"), random.Random(8)
    some = rows(400)
    for i, r in enumerate(some):
        r["tags"] |= {"XF": ("Z", "old")} if i % 2 else {}
        r["tags"] |= {"CB": ("Z", "AC"), "CR": ("Z", "x")} if i % 5 == 0 else {}
    bam.write(path, CONTIGS, some, block=700)
    monkeypatch.setattr(bam, "WINDOW", 500)
    monkeypatch.setattr(bam, "EDIT", 900)
    read = [b for s in bam.BamReader({"path": path}, ["ord", "raw"]).partitions() for b in bam.BamReader({"path": path}, ["ord", "raw"]).read(s)]
    raws = {o: bytes(r) for b in read for o, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    all_, left = sorted(raws), sorted(rnd.sample(sorted(raws), len(raws) // 3))
    for gap in (300, 4 << 20):
        monkeypatch.setattr(bam, "GAP", gap)
        for own, several in ((all_, True), (left, True), (all_, False), (left, False), ([], True)):
            groups, at = [], 0
            while at < len(own):
                n = rnd.randint(1, 9) if several else 1
                part = own[at : at + n]
                cut = [part[j::3] for j in range(3)] if several else [part]
                groups += sorted(g for g in cut if g)
                at += n
            tags = [{"XF": rnd.choice([None, 1, 4]), "XQ": rnd.choice([None, "", "a,b"]), "XP": rnd.choice([None, -3, 70_000]), "CB": rnd.choice([None, "AC", "GT"]), "CR": rnd.choice([None, "y"])} for _ in groups]
            kinds = {"XF": pa.int32(), "XQ": pa.string(), "XP": pa.int32(), "CB": pa.string(), "CR": pa.string()}
            place = pa.array(groups, pa.list_(pa.int64())) if several else pa.array([g[0] for g in groups], pa.int64())
            whole = pa.RecordBatch.from_arrays([place, *(pa.array([t[k] for t in tags], v) for k, v in kinds.items())], names=["ords" if several else "ord", *(f"{k}:{bam.EDITED[k]}" for k in kinds)])
            want = {}
            for g, t in zip(groups, tags, strict=True):
                for o in g:
                    old = {k: v for k, v in bam._raw_tags(raws[o])[1]}
                    row = {k: (bam.EDITED[k], str(v)) for k, v in t.items() if v is not None}
                    for k in ("XR", "CR"):  # XR is no column, CR has no value: left
                        if k in old and k not in row:
                            row[k] = (chr(old[k][2]), old[k][3:-1].decode())
                    want[o] = bam.edit(raws[o], row)
            got = [r for step in [3] for a in bam._annotated(path, (whole.slice(i, step) for i in range(0, len(groups), step))) for r in a.to_pylist()]
            assert got == [want[o] for o in own]


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("setup", [{}, {"umi": {"mode": "tag", "tag": "UB"}, "filter": [{"mode": "MultiMapper", "action": "remove"}]}, {"umi": {"mode": "tag", "tag": "UB"}, "dedup": {"mode": "umi"}}])
def test_annotated_bam_agrees_with_reads(spark, pile, tmp_path, monkeypatch, setup, broadcast):
    """Every read once, in file order, with the tags of its own status and hits, whether regions are broadcast or swept."""
    from readtally.operators import match

    if not broadcast:
        monkeypatch.setattr(match, "broadcastable", lambda table, most=0: False)
    (tmp_path / "a.gtf").write_text(GTF)
    source, out = {"mode": "gtf", "filename": str(tmp_path / "a.gtf"), "feature": "exon", "id_attribute": "gene_id"}, tmp_path / "out"
    c = config.from_dict({"input": {"bam": pile, "source": source}, "dedup": {"mode": "none"}, "output": {"directory": str(out), "write_annotated_bam": True}, **setup})
    sinks.write(spark, c)
    single = bam.scan(spark, pile, references=json.dumps(["chr1", "chr2"]))
    entries = quantify._table(spark, c)
    want = quantify.with_status(quantify.matched(quantify.annotated(single, c), c, entries)).orderBy("ord").collect()
    got = spark.read.format("bam").load(str(out / "annotated.bam")).orderBy("ord").collect()
    assert [r["qname"] for r in got] == [r["qname"] for r in want] and len(got) == 2000
    code = {"filtered": "1", "duplicate": "3"}
    for g, w in zip(got, want, strict=True):
        tags, done = {k: v["v"] for k, v in g["tags"].items()}, w["status"] not in code
        assert tags.get("XF") == code.get(w["status"]) and "CB" not in tags and tags.get("CR") == w["tags"].get("CR", {"v": None})["v"]
        assert tags.get("XQ") == (",".join(w["hits_correct"]) if done else None) and tags.get("XR") == (",".join(w["hits_reverse"]) if done else None)
        assert tags.get("XP") == (str(w["corrected"] + 1) if done else None) and tags["UB"] == w["tags"]["UB"]["v"]
    stats = dict(x.split("\t") for x in (out / "counts.tsv.stats.tsv").read_text().splitlines()[1:])
    assert {k: int(v) for k, v in stats.items() if v != "0"} == {s: sum(w["status"] == s for w in want) for s in {w["status"] for w in want}}


def test_no_record_travels(spark, pile, tmp_path):
    """Neither bytes, names nor tags of records leave the scan, and reads are neither sorted nor shuffled."""
    (tmp_path / "a.gtf").write_text(GTF)
    source = {"mode": "gtf", "filename": str(tmp_path / "a.gtf"), "feature": "exon", "id_attribute": "gene_id"}
    c = config.from_dict({"input": {"bam": pile, "source": source}, "dedup": {"mode": "none"}, "output": {"directory": "x", "write_annotated_bam": True}})
    result = quantify.run(spark, c)
    try:
        assert not {"raw", "qname", "seq", "tags"} & set(result.reads.columns) and result.in_file_order()
        rows_ = quantify.annotation_tags(quantify.with_status(result.reads), c)
        assert "Exchange" not in rows_._jdf.queryExecution().executedPlan().toString().partition("InMemoryTableScan")[0] and rows_.count() < 2000
    finally:
        result.release()
