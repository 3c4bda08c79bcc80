import pytest
from pyspark.sql import functions as F

from readtally.functions import reads as R


def _blocks(spark, cigar, pos=0, fn=R.blocks):
    row = spark.range(1).select(fn(R.parse_cigar(F.lit(cigar)), F.lit(pos)).alias("b")).first()
    return [(x["s"], x["e"]) for x in row["b"]]


@pytest.mark.parametrize(
    ("cigar", "expected"),
    [("50M", [(0, 50)]), ("6S45M", [(0, 45)]), ("7M2D44M", [(0, 7), (9, 53)]), ("23M4I24M", [(0, 23), (23, 47)]), ("17M2183N34M", [(0, 17), (2200, 2234)]), ("10M5=3X2M", [(0, 10), (10, 15), (15, 18), (18, 20)]), ("*", [])],
)
def test_blocks(spark, cigar, expected):
    assert _blocks(spark, cigar) == expected


def test_introns(spark):
    assert _blocks(spark, "1S7M3D19M2285N24M", 100, R.introns) == [(129, 2414)]


def test_clip_and_merge(spark):
    clip = lambda c: spark.range(1).select(R.corrected_position(R.parse_cigar(F.lit(c)), F.lit(3))).first()[0]
    assert (clip("5S45M"), clip("10H4S46M"), clip("50M"), clip("45M5S")) == (-2, -1, 3, 3)
    with pytest.raises(Exception, match="max_skip_length"):
        clip("151S45M")
    merged = lambda iv: spark.range(1).select(R.merged_length(F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("e")) for a, b in iv]))).first()[0]
    assert merged([(0, 10), (5, 20), (30, 40)]) == 30
    assert merged([(0, 10), (10, 20)]) == 20


def test_hamming(spark):
    h = lambda a, b: spark.range(1).select(R.hamming(F.lit(a), F.lit(b))).first()[0]
    assert (h("ACGT", "ACGA"), h("AAAA", "TTTT"), h("AC", "ACG")) == (1, 4, None)


def test_unset_groups(spark):
    """The first match decides: a group that it leaves unset gives none, whatever later ones set; an empty one is empty."""
    names = ["x", "xu=;", "u=AC;x", "u=;", "u=;u=AC;", "xxu=A;"]
    df = spark.createDataFrame([(n,) for n in names], "qname string")
    for pattern, want in ((r"(?d)x|u=([AC]*);", [None, None, "AC", "", "", None]), (r"(?d)^x*(u=;)?", [None, "u=;", None, "u=;", "u=;", None])):
        got = [r[0] for r in df.select(R.extractor({"mode": "regex_name", "regex": pattern, "groups": 1})).collect()]
        assert got == want, pattern
