"""The BAM source against a plain decoder, its indexes, filters that reach the scan, and files that appear whole."""

import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from readtally import config
from readtally.sources import bam, bam_index, bam_records, bgzf, sinks, stores

CONTIGS = [("chr1", 40_000_000), ("chr2", 5_000_000), ("empty", 100), ("lost", 1000)]
KINDS = [("C", "7"), ("c", "-3"), ("S", "60000"), ("s", "-300"), ("i", "-70000"), ("I", "4000000000"), ("f", "0.5"), ("A", "x"), ("Z", "text"), ("Z", ""), ("H", "1AFF"), ("B", "S,1,2,3"), ("B", "c,-1"), ("B", "f,0.5,2.0"), ("B", "i")]


def rows(n=900, seed=1):
    rnd, out = random.Random(seed), []
    for i in range(n):
        tid = 0 if i < n * 2 // 3 else 1
        cigar = [[("M", 30)], [("S", 3), ("M", 20), ("N", rnd.choice([50, 20_000, 3_000_000])), ("M", 7)], [("H", 2), ("=", 9), ("I", 1), ("X", 1), ("D", 4), ("P", 1), ("M", 5)]][i % 3]
        n_seq = sum(k for op, k in cigar if op in "MIS=X")
        tags = {k: rnd.choice(KINDS) for k in rnd.sample(["NH", "XA", "XB", "XC", "CB", "ZZ"], rnd.randint(0, 6))}
        pos = (i if tid == 0 else i - n * 2 // 3) * (60_000 if tid == 0 else 4000)
        out.append({"qname": f"r{i}" * rnd.randint(1, 4), "flag": rnd.choice([0, 16, 64, 256]), "tid": tid, "pos": pos, "mapq": i % 61, "cigar": cigar, "seq": "".join(rnd.choice("ACGTN=") for _ in range(n_seq)), "tags": tags})
    return out + [{"qname": "u", "flag": 4, "tid": 3, "pos": 5, "mapq": 0, "cigar": [], "seq": "ACG", "tags": {}}]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    out = {}
    for csi in (False, True):
        out[csi] = str(tmp_path_factory.mktemp("bam") / "a.bam")
        bam.write(out[csi], CONTIGS, rows(), block=3000, csi=csi)
    return out


def collected(df):
    return [(r["qname"], r["flag"], r["tid"], r["ref"], r["pos"], r["mapq"], [tuple(c) for c in r["cigar"]], r["seq"], {k: tuple(v) for k, v in r["tags"].items()}) for r in df.orderBy("ord").collect()]


def expected(keep=lambda r: True):
    return [(r["qname"], r["flag"], r["tid"], CONTIGS[r["tid"]][0], r["pos"], r["mapq"], r["cigar"], r["seq"], r["tags"]) for r in rows() if keep(r)]


@pytest.mark.parametrize("csi", [False, True])
def test_all_fields(spark, files, csi):
    bam.register(spark)
    df = spark.read.format("bam").option("split", 3000).load(files[csi])
    assert df.rdd.getNumPartitions() > 3 and collected(df) == expected()
    raws = [bytes(r["raw"]) for r in df.orderBy("ord").select("raw").collect()]
    assert raws == [bam.encode(r) for r in rows()]


def test_small_windows(spark, files, monkeypatch):
    """Records that straddle windows and blocks."""
    for size in (1, 500, 7000):
        monkeypatch.setattr(bam, "WINDOW", size)
        reader = bam.BamReader({"path": files[False]}, ["qname", "pos"])
        got = [n for p in reader.partitions() for b in reader.read(p) for n in b.column("qname").to_pylist()]
        assert got == [r["qname"] for r in rows()]


def test_both_indexes_give_the_same(files):
    bai, csi = (bam.index(files[k]) for k in (False, True))
    assert csi.by_bin and not bai.by_bin
    for tid in range(len(CONTIGS)):
        assert bai.contigs[tid].chunks == csi.contigs[tid].chunks and bai.contigs[tid].mapped == csi.contigs[tid].mapped
        for start in range(0, 36_000_000 if tid == 0 else 1_100_000, 170_000):
            # without a linear index more may be read, never less
            wide = csi.ranges(tid, start, start + 90_000)
            assert all(any(a <= b and e <= z for a, z in wide) for b, e in bai.ranges(tid, start, start + 90_000))
    spans = [[(s.tid, s.begin, s.end) for s in bam.BamReader({"path": files[k], "split": 3000}, ["pos"]).partitions()] for k in (False, True)]
    assert spans[0] == spans[1]


def test_index_bytes(files):
    """A plain parser finds the counts' bin, its numbers, and the linear index of 16 kb windows."""
    with open(files[False] + ".bai", "rb") as f:
        data = f.read()
    at, found = 8, []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        n, own = struct.unpack_from("<i", data, at)[0], {}
        at += 4
        for _ in range(n):
            number, k = struct.unpack_from("<Ii", data, at)
            own[number] = struct.unpack_from(f"<{2 * k}Q", data, at + 8)
            at += 8 + 16 * k
        k = struct.unpack_from("<i", data, at)[0]
        found.append((own, struct.unpack_from(f"<{k}Q", data, at + 4)))
        at += 4 + 8 * k
    assert struct.unpack_from("<Q", data, at)[0] == 0 and at + 8 == len(data)
    assert [f[0][37450][2:] if 37450 in f[0] else None for f in found] == [(600, 0), (300, 0), None, (0, 1)]
    # a window's offset is that of the first record that overlaps it, or comes later
    first = {}
    with open(files[False], "rb") as f:
        whole = f.read()
    offsets = list(plain_offsets(whole))
    for (voffset, _), r in zip(offsets, rows(), strict=True):
        span = sum(k for op, k in r["cigar"] if op in "MDN=X") or 1
        for w in range(r["pos"] >> 14, (r["pos"] + span - 1 >> 14) + 1):
            first.setdefault((r["tid"], w), voffset)
    for tid, (_, linear) in enumerate(found):
        own = {w: v for (t, w), v in first.items() if t == tid}
        assert len(linear) == max(own, default=-1) + 1
        assert list(linear) == [min(v for x, v in own.items() if x >= w) for w in range(len(linear))]


def plain_offsets(whole):
    """Virtual offset and bytes of each record, block by block."""
    at, data, places = 0, b"", []
    while at < len(whole):
        size = struct.unpack_from("<H", whole, at + 16)[0] + 1
        piece = zlib.decompress(whole[at + 18 : at + size - 8], -15)
        places += [at << 16 | k for k in range(len(piece))]
        data += piece
        at += size
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    n = struct.unpack_from("<i", data, at)[0]
    at += 4
    for _ in range(n):
        at += 8 + struct.unpack_from("<i", data, at)[0]
    while at < len(data):
        size = struct.unpack_from("<i", data, at)[0]
        yield places[at], data[at + 4 : at + 4 + size]
        at += 4 + size


def test_contigs_need_mapped_reads(files):
    assert bam.contigs_with_reads(files[False]) == bam.contigs_with_reads(files[True]) == ["chr1", "chr2"]


@pytest.mark.parametrize("csi", [False, True])
@pytest.mark.parametrize(
    "where, keep",
    [
        ("ref = 'chr1' and pos between 10000000 and 10900000", lambda r: r["tid"] == 0 and 10_000_000 <= r["pos"] <= 10_900_000),
        ("ref in ('chr2', 'none') and pos < 40000", lambda r: r["tid"] == 1 and r["pos"] < 40_000),
        ("pos = 60000", lambda r: r["pos"] == 60_000),
        ("pos > 35900000 and mapq >= 10 and flag in (0, 16)", lambda r: r["pos"] > 35_900_000 and r["mapq"] >= 10 and r["flag"] in (0, 16)),
        ("tid = 1 and flag = 64 and qname like 'r7%'", lambda r: r["tid"] == 1 and r["flag"] == 64 and r["qname"].startswith("r7")),
        ("pos < 0", lambda r: False),
        ("ref = 'chr1' and ref = 'chr2'", lambda r: False),
    ],
)
def test_filters_reach_the_scan(spark, files, csi, where, keep):
    bam.register(spark)
    load = lambda **o: spark.read.format("bam").option("split", 3000).options(**o).load(files[csi])
    assert collected(load(pushdown="true").where(where)) == expected(keep) == collected(load().where(where))


def test_ranges_prune(spark, files):
    bam.register(spark)
    load = lambda **o: spark.read.format("bam").option("split", 3000).options(**o).load(files[False])
    some = load(pushdown="true").where("ref = 'chr1' and pos between 10000000 and 10900000")
    assert some.rdd.getNumPartitions() * 2 <= load().rdd.getNumPartitions()
    assert "Filter (" not in some.select("ord")._jdf.queryExecution().executedPlan().toString()
    tests = [("ref", "=", "chr1"), ("pos", ">=", 10_000_000), ("pos", "<=", 10_900_000)]
    given = bam.scan(spark, files[False], tests, split=3000)
    assert given.rdd.getNumPartitions() == some.rdd.getNumPartitions() and collected(given) == collected(some)
    with pytest.raises(Exception, match="does not know the test"):
        bam.scan(spark, files[False], [("seq", "=", "A")]).count()
    # queries that share a DataFrame do not see each other's filters
    inside = len(expected(lambda r: r["tid"] == 0 and 10_000_000 <= r["pos"] <= 10_900_000))
    df = load()
    assert [df.where("tid = 0").count(), df.count(), df.where("tid = 1").count(), given.count(), given.where("mapq = 1").count() < given.count()] == [600, len(rows()), 300, inside, True]
    few = spark.read.format("bam").option("columns", '["pos", "tags"]').load(files[False])
    assert few.columns == ["pos", "tags"] and few.count() == len(rows())


def test_many_operations(spark, tmp_path):
    """More operations than a record's field counts are in a tag."""
    cigar = [("M", 1), ("D", 1)] * 40_000
    row = {"qname": "long", "flag": 0, "tid": 0, "pos": 10, "mapq": 1, "cigar": cigar, "seq": "A" * 40_000, "tags": {"NH": ("C", "1")}}
    path = str(tmp_path / "a.bam")
    bam.write(path, CONTIGS, [row | {"cigar": [("M", 40_000)], "pos": 5}, row])
    bam.register(spark)
    got = collected(spark.read.format("bam").load(path))[1]
    assert got[6] == cigar and got[8] == {"NH": ("C", "1")}
    assert (80_009 >> 14) + 1 == len(bam.index(path).contigs[0].least)


def test_long_contigs_have_a_csi(spark, tmp_path):
    path = str(tmp_path / "a.bam")
    far = [{"qname": "a", "flag": 0, "tid": 0, "pos": p, "mapq": 1, "cigar": [("M", 4)], "seq": "ACGT", "tags": {}} for p in (5, 700_000_000, 1_900_000_000)]
    bam.write(path, [("big", 2_000_000_000)], far)
    assert os.path.exists(path + ".csi") and not os.path.exists(path + ".bai") and bam.index(path).depth == 6
    bam.register(spark)
    assert [r["pos"] for r in spark.read.format("bam").load(path).where("pos > 6 and pos < 1000000000").collect()] == [700_000_000]


def test_bins():
    rnd = random.Random(2)
    for _ in range(2000):
        start = rnd.randrange(1 << 29)
        end = min(start + rnd.choice([1, 100, 20_000, 10**6, 10**8]), 1 << 29)
        plain = next((((1 << 3 * k) - 1) // 7 + (start >> 29 - 3 * k) for k in range(5, 0, -1) if start >> 29 - 3 * k == end - 1 >> 29 - 3 * k), 0)
        assert bam_index.bins(np.array([start]), np.array([end]))[0] == plain


def test_part_bytes_stay_with_the_tasks(spark, tmp_path, monkeypatch):
    bam.register(spark)
    source, one, two = str(tmp_path / "in.bam"), str(tmp_path / "one.bam"), str(tmp_path / "two.bam")
    bam.write(source, CONTIGS, [r for r in rows() if r["tid"] < 3])
    read, plain = [], stores.open_input
    monkeypatch.setattr(stores, "open_input", lambda path: read.append(path) or plain(path))
    df = spark.read.format("bam").load(source)
    bam.save(df, one, b"@HD\tVN:1.6\n", CONTIGS)
    assert read and not [p for p in read if "part-" in p and not p.endswith(".index")]
    assert collected(spark.read.format("bam").load(one)) == expected(lambda r: r["tid"] < 3)
    # a store that takes no ranges: one task streams
    monkeypatch.setattr(stores, "takes_ranges", lambda where: False)
    bam.save(df, two, b"@HD\tVN:1.6\n", CONTIGS)
    assert open(one, "rb").read() == open(two, "rb").read() and open(one + ".bai", "rb").read() == open(two + ".bai", "rb").read()
    assert not [p for p in read if "part-" in p and not p.endswith(".index")] and sorted(os.listdir(tmp_path)) == ["in.bam", "in.bam.bai", "one.bam", "one.bam.bai", "two.bam", "two.bam.bai"]
    bam.save(df.limit(0), one, b"", CONTIGS)
    assert spark.read.format("bam").load(one).count() == 0 and open(one, "rb").read().endswith(bgzf.EOF_BLOCK)


def test_offsets_of_a_joined_file(spark, tmp_path):
    """The index of a file made of parts points at its records."""
    bam.register(spark)
    source, out = str(tmp_path / "in.bam"), str(tmp_path / "out.bam")
    bam.write(source, CONTIGS, rows(), block=3000)
    df = spark.read.format("bam").option("split", 3000).load(source)
    bam.save(df.withColumn("x", F.lit(1)).repartition(7), out, b"", CONTIGS)
    with open(out, "rb") as f:
        at = {v for v, _ in plain_offsets(f.read())}
    found = bam.index(out)
    assert all(b in at for c in found.contigs for b in [x for k in c.chunks.values() for x, _ in k] + list(c.least.values()))
    assert [(c.mapped, c.unmapped) for c in found.contigs] == [(600, 0), (300, 0), (None, None), (0, 1)]
    got = spark.read.format("bam").load(out).where("ref = 'chr1' and pos between 3000000 and 3300000")
    assert collected(got) == expected(lambda r: r["tid"] == 0 and 3_000_000 <= r["pos"] <= 3_300_000)


def test_failed_runs_leave_nothing(spark, tmp_path):
    path, out = str(tmp_path / "in.bam"), tmp_path / "out"
    bad = rows(30) [:30]
    bad[17] = bad[17] | {"tags": {"UB": ("C", "1")}}
    for r in bad[:17] + bad[18:]:
        r["tags"] = {"UB": ("Z", "AC")}
    bam.write(path, CONTIGS, bad)
    setup = {"input": {"bam": path, "source": {"mode": "bam_references"}}, "umi": {"mode": "tag", "tag": "UB"}, "dedup": {"mode": "none"}, "output": {"directory": str(out), "write_annotated_bam": True}}
    with pytest.raises(Exception, match="UB"):
        sinks.write(spark, config.from_dict(setup))
    assert sorted(os.listdir(tmp_path)) == ["in.bam", "in.bam.bai"]
    # parts of attempts that failed go, too
    bam.register(spark)
    broken = spark.read.format("bam").load(path).withColumn("raw", F.when(F.col("pos") > 600_000, F.lit(b"x" * 40)).otherwise(F.col("raw")))
    with pytest.raises(Exception):
        bam.save(broken, str(tmp_path / "b.bam"), b"", CONTIGS)
    assert sorted(os.listdir(tmp_path)) == ["in.bam", "in.bam.bai"]


def test_only_correct(spark, tmp_path):
    path, out = str(tmp_path / "in.bam"), tmp_path / "out"
    own = [r | {"tags": {}} for r in rows(30)[:30]]
    bam.write(path, CONTIGS, own)
    setup = {"input": {"bam": path, "source": {"mode": "bam_references"}}, "dedup": {"mode": "none"}, "output": {"directory": str(out), "only_correct": True}}
    sinks.write(spark, config.from_dict(setup))
    n = [sum(r["tid"] == t and not r["flag"] & 16 for r in own) for t in range(4)]
    assert (out / "counts.tsv").read_text() == "reference\tcount\n" + "".join(f"{name}\t{k}\n" for (name, _), k in zip(CONTIGS, n, strict=True))


def test_unknown_tag_type():
    raw = bytearray(bam.encode(rows(3)[0] | {"tags": {"XA": ("C", "1")}}))
    raw[-2] = ord("?")
    data = np.frombuffer(struct.pack("<i", len(raw)) + bytes(raw), np.uint8)
    at, end = bam_records.starts(bytearray(data.tobytes()))
    with pytest.raises(ValueError, match="unknown tag type"):
        bam_records.decode(data, at + 4, np.array([end]), bam_records.heads(data, at + 4), at, ["tags"], None)


def piled(n=3000, seed=5):
    """Reads that pile up on few positions, with soft clips, few UMIs and cells."""
    rnd, out = random.Random(seed), []
    for tid in (0, 1):
        for pos in sorted(rnd.choice([rnd.randrange(60_000), rnd.randrange(20), 16_384 + rnd.randrange(-3, 3)]) for _ in range(n // 2)):
            clip = rnd.choice([0, 0, 1, 2, 7])
            cigar = ([("H", 1)] if rnd.random() < 0.1 else []) + ([("S", clip)] if clip else []) + [("M", 12)]
            tags = {"NH": ("C", str(rnd.randint(1, 3))), "UB": ("Z", rnd.choice(["AA", "AC", "NN"])), "CB": ("Z", rnd.choice("xy"))}
            out.append({"qname": f"r{len(out)}", "flag": rnd.choice([0, 16, 256]), "tid": tid, "pos": pos, "mapq": rnd.randrange(3), "cigar": cigar, "seq": "A" * (clip + 12), "tags": tags})
    return out


@pytest.mark.parametrize("clipped", [True, False])
@pytest.mark.parametrize("mode", ["umi", "sc"])
def test_duplicates_inside_partitions(spark, tmp_path, mode, clipped):
    """Whole buckets in each partition: every record once, and the same reads stay as with a window."""
    from readtally.plans import quantify

    path = str(tmp_path / "a.bam")
    bam.write(path, CONTIGS, piled(), block=2500)
    bam.register(spark)
    setup = {"input": {"bam": path, "correct_reads_for_clipping": clipped, "max_skip_length": 9, "source": {"mode": "bam_references"}}, "umi": {"mode": "tag", "tag": "UB"}, "dedup": {"mode": mode}, "output": {"directory": "x"}}
    setup |= {"filter": [{"mode": "n_in_umi", "action": "remove"}, {"mode": "non_primary", "action": "remove"}]}
    if mode == "sc":
        setup["cell_barcodes"] = {"extract": {"mode": "tag", "tag": "CB"}, "separator_char": "-"}
    c = config.from_dict(setup)
    plain = quantify.annotated(spark.read.format("bam").load(path), c)
    want = {r["ord"]: r["status"] for r in plain.collect()}
    assert 100 < sum(s == "duplicate" for s in want.values()) < len(want) - 100
    reach = 9 if clipped else 0
    for split in (1, 4000, 1 << 20):
        df = spark.read.format("bam").option("split", split).option("buckets", reach).option("clipped", str(clipped).lower()).load(path)
        got = quantify.annotated(df, c, reach=reach)
        rows_ = got.select("ord", "status").collect()
        assert len(rows_) == len(want) and {r["ord"]: r["status"] for r in rows_} == want, split
    assert df.rdd.getNumPartitions() == 2 and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    whole = quantify._scanned(spark, c, ["chr1", "chr2"], None)
    assert {r["ord"]: r["status"] for r in whole.select("ord", "status").collect()} == want


def test_large_spans_apart(files):
    """Spans are small or large, none is both, and together they are all."""
    names = ["pos"]
    spans = {k: [(s.tid, s.begin, s.end) for s in bam.BamReader({"path": files[False], "split": 10, "spans": k}, names).partitions()] for k in ("all", "small", "large")}
    assert sorted(spans["small"] + spans["large"]) == sorted(spans["all"] + ([(-1, 0, 0)] if [(-1, 0, 0)] in (spans["small"], spans["large"]) else []))
    assert not bam.has_large_spans(files[False], ["chr1", "chr2"])


def test_small_batches(monkeypatch):
    """Decisions do not depend on how the reads come in batches."""
    import pyarrow as pa

    from readtally.operators import dedup

    rnd, rows_ = random.Random(9), []
    for i in range(400):
        pos = i // 3
        rows_.append((rnd.random() < 0.9, pos, pos - rnd.choice([0, 0, 1, 4]), rnd.random() < 0.5, rnd.choice(["A", "C", None]), rnd.choice(["x", None]), rnd.randint(1, 2), rnd.randint(0, 1), i))
    kinds = [pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows_, strict=True), kinds, strict=True)]
    best = {}
    for live, _, bucket, rev, umi, cell, nh, mapq, order in rows_:
        if live:
            key = bucket, rev, umi, cell
            best[key] = min(best.get(key, (0, 0, 1 << 40)), (-nh, -mapq, order))
    want = [live and best[bucket, rev, umi, cell][2] != order for live, _, bucket, rev, umi, cell, nh, mapq, order in rows_]
    for size in (1, 7, 150, 400):
        pieces = (tuple(c.slice(i, size) for c in columns) for i in range(0, 400, size))
        assert [x for a in dedup._keep_best(4)(pieces) for x in a.to_pylist()] == want
