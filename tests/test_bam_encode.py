"""Records of a batch against those that are encoded one by one."""

import json

import pyarrow as pa
import pytest

from readtally.sources import bam, bam_encode
from readtally.sources.bam_records import TYPES
from test_bam import rows


def batch(rows_):
    names = [c for c in rows_[0] if c != "tid"] + ["tid"]
    each = {"cigar": lambda c: [{"op": o, "len": n} for o, n in c], "tags": lambda t: [(k, {"t": a, "v": b}) for k, (a, b) in t.items()]}
    return pa.RecordBatch.from_arrays([pa.array([each.get(c, lambda x: x)(r[c]) for r in rows_], TYPES[c]) for c in names], names=names)


def test_records():
    some = [{**r, "seq": r["seq"]} for r in rows(400)]
    whole = batch(some)
    for begin, n in ((0, len(some)), (13, 100), (5, 0)):
        got = bam_encode.records(whole.slice(begin, n), bam.EDITED, bam.encode, bam._encoded_tag)
        assert got.to_pylist() == [bam.encode(r) for r in some[begin : begin + n]]
    long = [some[0] | {"cigar": [("M", 1), ("I", 1)] * 40_000, "seq": "AC" * 40_000}]
    assert bam_encode.records(batch(long), bam.EDITED, bam.encode, bam._encoded_tag).to_pylist() == [bam.encode(long[0])]
    for wrong in ({"seq": "a"}, {"cigar": [("?", 1)]}, {"tags": {"XA": ("C", "256")}}, {"mapq": 256}):
        with pytest.raises(ValueError):
            bam_encode.records(batch([some[0] | wrong]), bam.EDITED, bam.encode, bam._encoded_tag)


def test_edited_records():
    old = rows(300)
    new = []
    for i, r in enumerate(old):
        tags = dict(r["tags"])
        if i % 3 == 0:
            tags["XF"] = ("C", "1")
        if i % 4 == 0:
            tags |= {"XQ": ("Z", "a,b"), "XR": ("Z", "")}
        if i % 5 == 0:
            tags["CB"] = ("Z", "ACGT")
        elif i % 5 == 1:
            tags.pop("CB", None)
        new.append({"raw": bam.encode(r), "tags": tags})
    whole = batch([{**r, "tid": 0} for r in new])
    got = bam_encode.records(whole, bam.EDITED, bam.encode, bam._encoded_tag)
    assert got.to_pylist() == [bam.encode(r) for r in new]
    assert bam_encode.records(whole.slice(7, 50), bam.EDITED, bam.encode, bam._encoded_tag).to_pylist() == got.to_pylist()[7:57]


def test_tags_as_columns():
    """The same bytes as from a map of tags, which costs most of a record's way to Python."""
    some = [r | {"tags": {"XF": ("Z", f"g{i}"), "NH": ("C", str(i % 200))} | ({"CB": ("Z", "AC" * (i % 3))} if i % 5 else {})} for i, r in enumerate(rows(300))]
    names = [c for c in some[0] if c != "tags"]
    tags = {f"{k}:{t}": pa.array([r["tags"].get(k, (t, None))[1] for r in some], pa.string()) for k, t in (("XF", "Z"), ("CB", "Z"), ("NH", "C"))}
    plain = batch(some)
    columns = pa.RecordBatch.from_arrays([*(plain.column(c) for c in names), *tags.values()], names=[*names, *tags])
    want = [bam.encode(r) for r in some]
    for begin, n in ((0, len(some)), (13, 100), (5, 0)):
        assert bam_encode.records(columns.slice(begin, n), bam.EDITED, bam.encode, bam._encoded_tag).to_pylist() == want[begin : begin + n]
    long = batch([some[1] | {"cigar": [("M", 1), ("I", 1)] * 40_000, "seq": "AC" * 40_000}])
    both = pa.RecordBatch.from_arrays([*(long.column(c) for c in names), *(c.slice(1, 1) for c in tags.values())], names=[*names, *tags])
    want = bam.encode(some[1] | {"cigar": [("M", 1), ("I", 1)] * 40_000, "seq": "AC" * 40_000})
    assert bam_encode.records(both, bam.EDITED, bam.encode, bam._encoded_tag).to_pylist() == [want]
    with pytest.raises(ValueError, match="not both"):
        bam_encode.records(pa.RecordBatch.from_arrays([*plain.columns, tags["NH:C"]], names=[*plain.schema.names, "NH:C"]), bam.EDITED, bam.encode, bam._encoded_tag)


def test_scan_decodes_the_tags_it_is_asked_for(spark, tmp_path):
    from pyspark.sql import functions as F

    path, all_ = str(tmp_path / "a.bam"), rows(200)
    bam.write(path, [("chr1", 1 << 28), ("chr2", 1 << 28), ("chr3", 1 << 28)], all_)
    whole = {r["ord"]: r["tags"] for r in bam.scan(spark, path, columns=["ord", "tags"]).collect()}
    for only in (["CB"], ["NH", "CB"], ["ZZ"], []):
        some = {r["ord"]: r["tags"] for r in bam.scan(spark, path, columns=["ord", "tags"], tags=json.dumps(only)).collect()}
        assert some == {k: {n: v for n, v in t.items() if n in only} for k, t in whole.items()} and len(some) > 100
    assert bam.scan(spark, path, columns=["cigar"], tags="[]").where(F.size("cigar") > 0).count() > 100


def test_cigars_as_text():
    """The same bytes as from lists, also for more operations than the field counts."""
    some = rows(300) + [rows(1)[0] | {"cigar": [("M", 1), ("I", 1)] * 40_000, "seq": "AC" * 40_000}]
    for part in (some[:-1], some):
        plain = batch(part)
        text = pa.array(["".join(f"{n}{op}" for op, n in r["cigar"]) or None for r in part], pa.string())
        got = plain.set_column(plain.schema.get_field_index("cigar"), "cigar", text)
        assert bam_encode.records(got, bam.EDITED, bam.encode, bam._encoded_tag).to_pylist() == [bam.encode(r) for r in part]
    for wrong in ("M", "5", "5M3", "5Y", "5M 3S"):
        with pytest.raises(ValueError, match="no CIGAR"):
            bam_encode.records(got.slice(0, 1).set_column(got.schema.get_field_index("cigar"), "cigar", pa.array([wrong])), bam.EDITED, bam.encode, bam._encoded_tag)
