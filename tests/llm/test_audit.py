"""The filter audit against a plain simulation of all orders."""

import collections
import itertools
import re

import pytest
from pyspark.sql import functions as F

from readtally.llm import audit
from test_operators import text

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def rows():
    long = text(5, 260)
    own = [(1, long, "a"), (2, long, "a"), (3, None, "a"), (4, "", "b"), (5, "WORD " * 300, "b"), (6, long + " #", None), (7, "x y z", ""), (None, long, "a"), (None, long, "b"), (7, "x y z", ""), (7, "other", "a"), (8, "a\x0bb\x0cc\x1cd " * 100, "c"), (9, text(6, 300).upper() + "|", "c"), (10, text(6, 300).upper() + "|", "c")]
    return [(*r, "k", 3) for r in own]


LABELS = [(1, 1, 0), (2, 1, 0), (2, 0, 1), (5, None, 1), (9, 1, 1), (None, 1, 1), (7, 0, None)]


def simulated():
    docs = [(i, t or "", s or "") for i, t, s, *_ in rows()]
    good = {i for i, q, _ in LABELS if q == 1 and i is not None}
    toxic = {i for i, _, x in LABELS if x == 1 and i is not None}
    fails = []
    for i, t, _ in docs:
        w = re.findall(audit.WORD, t)
        e = i is not None and any(j is not None and j < i and u == t for j, u, _ in docs)
        fails.append("".join(n for n, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t), e), strict=True) if x))
    out, shapley = {}, collections.Counter()
    for part in {s for _, _, s in docs}:
        own = [(i, f) for (i, _, s), f in zip(docs, fails, strict=True) if s == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                shapley[part, name] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), sum(name in f for _, f in own) - len(gone), sum(f == name for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture
def tables(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, part string, mask int")
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_all_orders(tables):
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[f] for f in (*FIELDS, "shapley")) for r in audit.audit(*tables).collect()}
    assert got == simulated() and len(got) == 4 * 600


def test_without_broadcasts(tables, monkeypatch):
    """The joins of larger tables give the same."""
    monkeypatch.setattr(audit, "small", lambda t: t.hint("merge"))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[f] for f in (*FIELDS, "shapley")) for r in audit.audit(*tables).collect()}
    assert got == simulated()


def test_transform_inverts(spark):
    counts = [(i * i * 37 + 11) % 1000 for i in range(32)]
    masked = spark.range(32).select(F.lit("p").alias("part"), F.lit(True).alias("good"), F.lit(False).alias("toxic"), F.explode(F.array_repeat(F.col("id").cast("int"), F.get(F.array(*map(F.lit, counts)), F.col("id").cast("int")))).alias("mask"))
    row = audit.parity_sums(masked).select("sums", audit.inverted(F.col("sums")).alias("counts")).first()
    assert row["counts"] == counts
    assert row["sums"] == [sum((-1) ** (s & m).bit_count() * n for m, n in enumerate(counts)) for s in range(32)]


def test_empty(tables):
    docs, labels = tables
    assert audit.audit(docs.limit(0), labels).count() == 0
    none = audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(none) == (0, 0)
