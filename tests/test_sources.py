import pytest

from readtally import config
from readtally.operators import barcodes
from readtally.sources import annotation, bam, sinks


def _reads():
    for i in range(300):
        yield {"qname": f"r{i}:UMI_{'ACGT'[i % 4]}A:", "flag": 16 * (i % 2), "tid": i // 200, "pos": 10 * (i % 200), "mapq": 30, "cigar": [("M", 20), ("N", 5), ("M", 10)], "seq": "ACGTN" * 6, "tags": {"NH": ("C", "1"), "XF": ("Z", "g1"), "XB": ("B", "S,1,2")}}


@pytest.fixture
def bam_file(tmp_path):
    path = str(tmp_path / "a.bam")
    bam.write(path, [("chr1", 10000), ("chr2", 5000), ("chr3", 100)], _reads(), block=2000)
    return path


def test_bam_round_trip(spark, bam_file):
    bam.register(spark)
    rows = spark.read.format("bam").load(bam_file).orderBy("ord").collect()
    assert [(r["qname"], r["ref"], r["pos"], r["flag"]) for r in rows] == [(x["qname"], f"chr{x['tid'] + 1}", x["pos"], x["flag"]) for x in _reads()]
    assert rows[0]["seq"] == "ACGTN" * 6 and {k: tuple(v) for k, v in rows[0]["tags"].items()} == {"NH": ("C", "1"), "XF": ("Z", "g1"), "XB": ("B", "S,1,2")}
    assert spark.read.format("bam").option("references", '["chr2"]').load(bam_file).count() == 100
    assert spark.read.format("bam").option("references", "[]").load(bam_file).count() == 0


def test_bam_splits(spark, tmp_path):
    """A contig is several tasks; no record is lost or read twice."""
    path = str(tmp_path / "wide.bam")
    rows = [x | {"tid": 0, "pos": 20_000 * i} for i, x in enumerate(_reads())]
    bam.write(path, [("chr1", 10_000_000)], rows, block=2000)
    bam.register(spark)
    df = spark.read.format("bam").option("split", 1500).load(path)
    assert df.rdd.getNumPartitions() > 3 and [r["qname"] for r in df.orderBy("ord").collect()] == [x["qname"] for x in rows]


def test_no_index(spark, bam_file):
    import os

    os.remove(bam_file + ".bai")
    with pytest.raises(FileNotFoundError, match="please create an index"):
        bam.index(bam_file)


def test_gtf(spark, tmp_path):
    p = tmp_path / "a.gtf"
    p.write_text('#c\n\nchr1\tx\texon\t1\t100\t.\t+\t.\tgene_id "g1"; tag "a"; tag "b";\nchr1\tx\tgene\t1\t9\t.\t+\t.\tgene_id "g0";\nchr2\tx\texon\t11\t20\t.\t_\t.\tgene_id "g2";\nchr2\tx\texon\t11\t20\t.\t-\t.\tother "o";\n')
    got = annotation.regions(annotation.gtf(spark, str(p), "exon", ["gene_id"]), "gene_id").orderBy("id").collect()
    assert [(r["ref"], r["start"], r["end"], r["strand"], r["id"]) for r in got] == [("chr1", 0, 100, "+", "g1"), ("chr2", 10, 20, ".", "g2")]
    q = tmp_path / "a.gff"
    q.write_text("chr1\tx\texon\t5\t6\t.\t-\t.\tgene_id=g|1;n=2\n")
    assert annotation.gtf(spark, str(q), "exon", ["gene_id"]).first()["attrs"] == {"gene_id": "g|1"}


@pytest.mark.parametrize(
    ("line", "text"),
    [
        ('chr1\tx\texon\tone\t9\t.\t+\t.\tgene_id "g";', "start is no number"),
        ('chr1\tx\texon\t1\t9x\t.\t+\t.\tgene_id "g";', "end is no number"),
        ('chr1\tx\texon\t0\t9\t.\t+\t.\tgene_id "g";', "start must be positive"),
        ('chr1\tx\texon\t1\t9\t.\t?\t.\tgene_id "g";', "unknown strand"),
        ("chr1\tx\texon\t1\t9\t.\t+\t.", "a field is missing"),
        ('chr1\tx\texon\t1\t9\t.\t+\t.\tgene_id "g"; gene_id "h";', "DUPLICATED_MAP_KEY"),
        ("chr1\tx\texon\t1\t9\t.\t+\t.\tgene_id; other 1;", "an attribute has no value"),
    ],
)
def test_gtf_errors(spark, tmp_path, line, text):
    p = tmp_path / "a.gtf"
    p.write_text(line + "\n")
    with pytest.raises(Exception, match=text):
        annotation.gtf(spark, str(p), "exon", ["gene_id"], "gtf").collect()


def test_gtf_values(spark, tmp_path):
    """Quotes go at a value's ends only, blanks behind it only; keys without value matter only if they are asked for."""
    p = tmp_path / "a.gtf"
    p.write_text('chr1\tx\texon\t1\t9\t.\t+\t.\tgene_id "a "b" c"  ; lonely;\nchr1\tx\texon\t1\t9\t.\t+\t.\tgene_id   g;\n')
    assert [r["attrs"]["gene_id"] for r in annotation.gtf(spark, str(p), "exon", ["gene_id"]).orderBy("ord").collect()] == ['a "b" c', "  g"]


def test_packed_files(spark, tmp_path):
    import gzip

    import zstandard

    line = b'chr1\tx\texon\t1\t9\t.\t+\t.\tgene_id "g";\n' * 3
    for name, data in (("a.gz", gzip.compress(line)), ("b.txt", gzip.compress(line)), ("c.zst", zstandard.compress(line)), ("d.gtf", zstandard.compress(line[:50]) + zstandard.compress(line[50:]))):
        (tmp_path / name).write_bytes(data)
        assert annotation.gtf(spark, str(tmp_path / name), "exon", ["gene_id"]).count() == 3


def test_barcodes_by_both_distances(spark):
    """Packed words and others (long, or of other letters) give what plain counting gives."""
    import random

    rnd = random.Random(4)
    entries = ["".join(rnd.choice("ACGT") for _ in range(n)) for n in (8, 8, 8, 16, 16, 20) for _ in range(15)] + ["abcdefgh", "ACGTXYZW"]
    changed = []
    for e in entries * 3:
        w = list(e)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice("ACGTNX")
        changed.append("".join(w))
    lists = spark.createDataFrame([(0, e) for e in entries], "segment int, entry string")
    reads = spark.createDataFrame([(w,) for w in set(changed)], "raw_barcode string")
    far = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else 99
    for most in (0, 1, 2):
        want = {w: min(((far(w, e), e) for e in entries if far(w, e) <= most), default=(0, None))[1] for w in changed}
        assert {r["raw_barcode"]: r["barcode"] for r in barcodes.correct(reads, lists, "-", most).collect()} == want


def test_barcodes(spark):
    lists = spark.createDataFrame([(0, "AAAA"), (0, "CCCC"), (1, "GG")], "segment int, entry string")
    reads = spark.createDataFrame([("AAAA-GG-zz",), ("AAAT-GG",), ("AATT-GG",), ("CCCC",), ("AAAA-GC",), ("AAA-GG",), (None,)], "raw_barcode string")
    got = {r["raw_barcode"]: r["barcode"] for r in barcodes.correct(reads, lists, "-", 1).collect()}
    assert got == {"AAAA-GG-zz": "AAAA-GG", "AAAT-GG": "AAAA-GG", "AATT-GG": None, "CCCC": "CCCC", "AAAA-GC": "AAAA-GG", "AAA-GG": None, None: None}


def test_end_to_end(spark, bam_file, tmp_path):
    out = tmp_path / "out"
    c = config.from_dict({"input": {"bam": bam_file, "source": {"mode": "bam_references"}}, "dedup": {"mode": "none"}, "output": {"directory": str(out), "write_annotated_bam": True}})
    sinks.write(spark, c)
    assert (out / "counts.tsv").read_text() == "reference\tcount_correct\tcount_reverse\nchr1\t100\t100\nchr2\t50\t50\nchr3\t0\t0\n"
    stats = dict(x.split("\t") for x in (out / "counts.tsv.stats.tsv").read_text().splitlines()[1:])
    assert stats["correct"] == "150" and stats["reverse"] == "150" and len(stats) == 9
    rows = spark.read.format("bam").load(str(out / "annotated.bam")).orderBy("ord").collect()
    assert len(rows) == 300 and rows[0]["tags"]["XQ"]["v"] == "chr1" and rows[0]["tags"]["XP"]["v"] == "1"


def test_annotated_bam_keeps_records(spark, tmp_path, monkeypatch):
    import struct

    plain, made = bam.encode, []

    def with_mate(row):
        if row.get("raw") is not None:
            return plain(row)
        raw = bytearray(plain(row))
        struct.pack_into("<iii", raw, 20, row["tid"], row["pos"] + 50, 85)
        at = 32 + raw[8] + 4 * len(row["cigar"]) + (len(row["seq"]) + 1) // 2
        raw[at : at + len(row["seq"])] = bytes(range(len(row["seq"])))
        made.append(bytes(raw))
        return bytes(raw)

    text = b"@HD\tVN:1.6\tSO:coordinate\n@RG\tID:a\tSM:b\n@PG\tID:p\n" + b"@CO\tlong header\n" * 6000
    path, out = str(tmp_path / "a.bam"), tmp_path / "out"
    monkeypatch.setattr(bam, "encode", with_mate)
    bam.write(path, [("chr1", 10000), ("chr2", 5000)], _reads(), block=2000, text=text)
    monkeypatch.undo()
    sinks.write(spark, config.from_dict({"input": {"bam": path, "source": {"mode": "bam_references"}}, "dedup": {"mode": "none"}, "output": {"directory": str(out), "write_annotated_bam": True}}))
    assert bam.header_bytes(str(out / "annotated.bam")) == text
    rows = spark.read.format("bam").load(str(out / "annotated.bam")).orderBy("ord").collect()
    assert len(rows) == len(made) == 300
    for r, old in zip(rows, made, strict=True):
        at = old.index(b"NHC")
        assert bytes(r["raw"])[:at] == old[:at] and r["tags"]["XP"]["v"] == str(r["pos"] + 1) and tuple(r["tags"]["XB"]) == ("B", "S,1,2")


def test_single_cell(spark, bam_file, tmp_path):
    out = tmp_path / "out"
    umi = {"mode": "search_in_name", "search": "UMI_", "skip": 0, "len": 2}
    c = config.from_dict({"input": {"bam": bam_file, "source": {"mode": "bam_tag", "tag": "XF"}}, "dedup": {"mode": "sc", "bucket": "PerReference"}, "umi": umi, "cell_barcodes": {"extract": umi, "separator_char": "-"}, "output": {"directory": str(out)}})
    sinks.write(spark, c)
    assert (out / "features.tsv").read_text() == "g1\n"
    assert (out / "barcodes.tsv").read_text() == "AA\nCA\nGA\nTA\n"
    assert (out / "matrix.mtx").read_text().splitlines()[2:] == ["1 4 4", "1 1 2", "1 2 2", "1 3 2", "1 4 2"]
