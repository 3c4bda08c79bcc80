"""Operators and the pipeline against plain Python versions, and queries against their SQL on small tables of edge cases."""

import os
import re

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from readtally.llm import fingerprints, lines, mixing, quality, queries, shared, toxicity

from test_operators import LOW, WORD, text

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(*parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else (p & MASK).to_bytes(8, "little"), seed=h)
    return signed(h)


def kept_grams(t):
    pieces = [x for x in re.split("[ \n]", t) if x]
    tokens = [c for p in pieces for c in (p if len(p) > fingerprints.LONG_TOKEN else [p])]
    if not t:
        return []
    if len(tokens) < fingerprints.K:
        return [(xx(t), 0)]
    rolled = []
    for i in range(len(tokens) - fingerprints.K + 1):
        h = 0
        for x in tokens[i : i + fingerprints.K]:
            h = ((h << 1 | h >> 63) & MASK) ^ (xx(x) & MASK)
        rolled.append(xx(signed(h)))
    low = (1 << 31) - 1
    order = lambda i: (rolled[i] & ~low, -i)
    windows = [range(a, a + fingerprints.W) for a in range(max(1, len(rolled) - fingerprints.W + 1))]
    out = []
    for w in windows:
        best = min((i for i in w if i < len(rolled)), key=order)
        if not out or out[-1] != best:
            out.append(best)
    return [(rolled[i], i) for i in out]


def test_winnowing(spark):
    han = "".join(chr(0x4E00 + (i * 131 + i * i * 7) % 9000) for i in range(400))
    texts = ["", "a b", "a  b\nc d e", text(3, 300), "x " * 90, han, han[:200] + text(5, 40), "w" * 30 + " " + text(6, 30), text(8, 20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(g["hash"], g["position"]) for g in r["fingerprint_grams"]] for r in fingerprints.fingerprint(df).collect()}
    assert got == {i: kept_grams(t) for i, t in enumerate(texts)}
    near = df.select(fingerprints.likeness(*(fingerprints.hashes(fingerprints.winnow(F.lit(texts[i]))) for i in (5, 6))).alias("x")).first()["x"]
    assert near > 0.3


ODD = "acegikmoqsuwyACEGIKMOQSUWY13579"


def cut_lines(t):
    out, begin = [], 0
    for i in range(1, len(t)):
        if t[i - 1] in " \n" and t[i] not in " \n":
            odd = lambda c: c in ODD or ord(c) >= 0x80
            if odd(t[i]) or t[i - 1] == "\n" or i > 1 and (odd(t[i - 2]) or t[i - 2] in ".!?"):
                out.append(t[begin:i])
                begin = i
    return [*out, t[begin:]]


def chunks(t):
    own = cut_lines(t)
    h = [xx(x) & MASK for x in own]
    r = [signed(((a << 1 | a >> 63) & MASK) ^ b) for a, b in zip(h, h[1:], strict=False)]
    out = [[]]
    for i, w in enumerate(own):
        around = range(i - lines.REACH, i + lines.REACH + 1)
        if around[0] >= 0 and around[-1] < len(r) and r[i] < 0 and all(r[i] < r[k] if k < i else r[i] <= r[k] for k in around if k != i):
            out.append([])
        out[-1].append(w)
    return ["".join(c) for c in out]


def test_lines_and_rolling_hashes(spark):
    texts = ["one sentence. The next.\nA line\n\nbut flat rent is\ttabbed  twice", text(60, 80), "漢字かな x", "", "\x01 a\x02b \x01"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    got = [(r["l"], r["c"]) for r in df.select(lines.lines(F.col("text")).alias("l"), lines.cut(F.col("text")).alias("c")).collect()]
    for x, (own, parts) in zip(texts, got, strict=True):
        assert "".join(own) == x == "".join(parts)
        if not x.startswith("漢"):
            assert own == cut_lines(x) and parts == chunks(x)
    assert got[2][0] == ["漢", "字", "か", "な ", "x"] and len(got[1][1]) > 5 and min(len(cut_lines(c)) for c in got[1][1][1:]) >= 3


def test_first_of_documents_without_id(spark):
    """Documents that share id, or have none, keep a repeated passage once."""
    passage = text(70, 200)
    rows = [(None, passage + f" {text(80 + i, 5)}") for i in range(6)] + [(7, passage + " x"), (7, passage + " y")]
    got = lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    middle = " ".join(passage.split()[60:140])
    assert sum(middle in r["text"] for r in got) == 1 and [r["doc_id"] for r in got if middle in r["text"]] == [7]
    alone = lines.without_repeats(spark.createDataFrame(rows[:6], "doc_id long, text string")).collect()
    assert sum(middle in r["text"] for r in alone) == 1


def test_chunks_of_one_hash(spark, monkeypatch):
    """With a hash of few values all repeated chunks collide, and are still told apart by their bytes."""
    passage, other = text(70, 200), text(71, 150)
    rows = [(i, f"{text(90 + i, 30)} {passage if i < 3 else other} {text(190 + i, 30)}") for i in range(6)] + [(9, passage + " " + passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, lines.without_repeats(df).collect()))
    plain = F.xxhash64
    coarse = lambda *c: F.pmod(plain(*c), F.lit(3)) if len(c) == 1 and isinstance(c[0], str) else plain(*c)
    monkeypatch.setattr(lines.F, "xxhash64", coarse)
    assert sorted(map(tuple, lines.without_repeats(df).collect())) == want and sum(r[2] > 0 for r in want) == 5


def test_any_filter_size(spark, monkeypatch):
    """The bit table's size and the joins' forms change no result."""
    passage = text(70, 200)
    df = spark.createDataFrame([(i, f"{text(90 + i, 30)} {passage} {text(190 + i, 30)}") for i in range(5)], "doc_id long, text string")
    want = sorted(map(tuple, lines.without_repeats(df).collect()))
    monkeypatch.setattr(lines, "LEAST_ROWS", 1)
    monkeypatch.setattr(lines, "MOST_ROWS", 1)
    monkeypatch.setattr(lines, "small", lambda t, **_: t.hint("merge"))
    assert sorted(map(tuple, lines.without_repeats(df).collect())) == want and lines._rows_for(10**9) == 1
    assert sum(r[2] > 0 for r in want) == 4


def test_line_chunks_by_hand(spark):
    passage, tail = text(50, 120), text(51, 70)
    texts = [text(1, 40) + " " + passage, passage + " " + text(2, 40), None, "", passage + " x " + passage, tail + "\n" + text(3, 30), text(4, 30) + "\n" + tail, text(9, 5000) + " " + tail]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    first, found = {}, {}
    for i, t in enumerate(texts):
        for no, c in enumerate(chunks(t) if t else []):
            first.setdefault(c, (i, no))
    for i, t in enumerate(texts):
        parts = chunks(t) if t else []
        gone = [first[c] != (i, no) for no, c in enumerate(parts)]
        no = 0
        while no < len(parts):
            end = no
            while end < len(parts) and gone[end]:
                end += 1
            run = "".join(parts[no:end])
            if end > no and (len(run.split()) < lines.MIN_WORDS or len(run) < lines.MIN_CHARS):
                gone[no:end] = [False] * (end - no)
            no = max(end, no + 1)
        found[i] = None if t is None else "".join(c for c, g in zip(parts, gone, strict=True) if not g)
    got = lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r["text"] == found[r["doc_id"]] for r in got)
    assert sum(len(texts[r["doc_id"]] or "") - len(r["text"] or "") for r in got) > 1000


def test_quality_ratios_by_hand(spark):
    """Weights are the sums of the n-grams' log ratios, computed here from strings."""
    import collections
    import math

    rows = [(i, text(i % 7, 12) + (" !!" if i % 5 == 0 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 60, 3)], "doc_id long, quality int, toxic int")

    def grams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower())
        two = [("twice",) if a == b else (a, b) for a, b in zip(w, w[1:], strict=False)]
        return [(x,) for x in w] + two

    raw = collections.Counter(g for _, t in rows for g in grams(t))
    good = collections.Counter(g for i, t in rows if i % 3 == 0 and i % 5 for g in grams(t))
    share = sum(good.values()) / sum(raw.values())
    ratio = {g: math.log((good[g] + quality.SMOOTHING) / (n * share + quality.SMOOTHING)) for g, n in raw.items()}
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    off = [i for i, t in rows if abs(got[i]["log_weight"] - sum(ratio[g] for g in grams(t))) > 1e-9 or got[i]["n_grams"] != len(grams(t))]
    assert len({i % 7 for i in off}) <= 3  # hash buckets that two n-grams share
    keys = sorted((r["gumbel_key"] for r in got.values()), reverse=True)
    k = sum(r["accepted"] for r in got.values())
    assert all(r["accepted"] == (r["gumbel_key"] >= keys[k - 1]) for r in got.values())


def test_toxicity_held_out(spark):
    """Two vocabularies of insults, one in another script; texts that the chain has not seen."""
    bad = ["idiot scum moron", "дурак мразь тупой"]
    rows = [(i, text(i, 50) + (" " + bad[i % 2] if i % 6 < 2 else "")) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 6 < 2)) for i in range(600)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs.union(docs.limit(1)), chain).collect()}
    found = [i for i in range(600, 900) if got[i]["toxic"]]
    assert sum(i % 6 < 2 for i in found) >= 95 and sum(i % 6 >= 2 for i in found) <= 2
    assert all(0 <= got[i][f"p_{n}"] <= 1 for i in got for n in toxicity.NAMES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    base = text(1, 120)
    docs = [(1, base), (2, base), (3, base + " one more"), (4, None), (5, ""), (6, "All rights reserved. cc by CC BY, GNU General Public License"), (8, text(2, 3000)), (1, base), (None, text(5, 30)), (11, text(6, 60) + " " + " ".join(base.split()[:14]) + " x"), (12, "Permission is hereby granted, free of charge"), (13, "two words"), (14, "a a a a a a a a a a a a a a a a a a a a")]
    docs += [(20 + i, text(100 + i, 60) + (" $$$ ### $$$" * 9 if i % 4 == 0 else "")) for i in range(40)]
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    write([(i, t, "en", None if i == 4 else f"s{(i or 0) % 4}", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long", "documents")
    write([(1, " ".join(base.split()[:13])), (2, " ".join(base.split()[50:75]).upper()), (3, "two words"), (4, None), (5, " ... "), (3, "two words"), (6, "a " * 15)], "item_id long, text string", "benchmark")
    write([(20 + i, int(i % 4 > 0), 0) for i in range(40)] + [(i, 1, 0) for i in range(1, 15)], "doc_id long, quality int, toxic int", "labels")
    write([(1, "http://a.org", "same"), (3, "http://b.org", "same"), (4, None, None), (5, "http://c.org", ""), (6, "c", "é" * 5000), (7, "http://a.org/2", "same"), (8, "x", "")], "page_id long, url string, html string", "pages")
    write([(1, 0, "user", "a"), (1, 1, "assistant", "b </s>"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string", "conversations")
    return path


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, folder, name):
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{folder}/{t}/*.parquet'")
    df = queries.QUERIES[name](spark, folder)
    want = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    shown = lambda rows: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows], key=lambda r: tuple((v is not None, str(v)) for v in r))
    assert shown(tuple(r) for r in df.collect()) == shown(want.select(*[f'"{c}"' for c in df.columns]).fetchall())


def test_large_benchmark_path(spark, folder):
    """Beyond the prefilter the same rows come from the join."""
    from readtally.llm import decontaminate

    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    a, b = (sorted(decontaminate.contamination(docs, items, n).collect(), key=str) for n in (decontaminate.PREFILTER, 0))
    assert a == b and sum(r["n_hit"] > 0 for r in a) >= 5


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, folder), name)
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good, cut, single, clean = kept
    # junk goes, clean text stays
    assert not {20 + i for i in range(0, 40, 4)} & set(good) and {20 + i for i in range(40) if i % 4} <= set(good)
    # the copy and the extended copy of document 1 lose what it has
    assert cut[1] == text(1, 120) and 2 not in cut and len(cut.get(3, "")) < 120 and cut[4] is None and cut[5] == ""
    assert set(single) <= set(cut) and {20 + i for i in range(40) if i % 4} <= set(single) and list(single).count(1) == 1
    # documents 1 (all of item 2), 13 and 14 hold benchmark text
    assert not {1, 13, 14} & set(clean) and {20 + i for i in range(40) if i % 4} <= set(clean)
    out = corpus_pipeline.run(spark, folder).collect()
    sizes = {r["doc_id"]: len((r["text"] or "").split()) for r in out}
    assert {r["doc_id"] for r in out} <= set(clean) and sum(sizes.values()) > 0
    expected = mixing.stage(spark, docs, folder).collect()
    assert sorted(map(str, expected)) == sorted(map(str, out))


def test_pipeline_without_rows(spark, folder, tmp_path):
    import shutil

    path = str(tmp_path / "empty")
    shutil.copytree(folder, path)
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_words_of_brute_force():
    assert WORD.findall("A-b é9".translate(LOW)) == ["a", "b", "é9"]


def test_decontamination_plan_and_many_hits(spark):
    """With a small benchmark no document is shuffled; a text that is made of items has all words hit, by both ways."""
    from readtally.llm import decontaminate

    items = [(i, text(900 + i, 20)) for i in range(40)]
    long = " ".join(items[i % 40][1] for i in range(1500))
    docs = spark.createDataFrame([(1, long), (2, text(5, 100)), (3, None), (4, items[3][1] + " " + text(6, 30))] + [(10 + i, text(2000 + i, 40)) for i in range(50)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    small = decontaminate.contamination(docs, bench)
    assert "Exchange" not in small._jdf.queryExecution().executedPlan().toString()
    got, joined = (sorted(map(tuple, df.collect())) for df in (small, decontaminate.contamination(docs, bench, 0)))
    assert got == joined
    by_id = {r[0]: r for r in got}
    assert by_id[1][2:5] == (30_000, 30_000, 40) and by_id[4][3] == 20 and by_id[2][3] == by_id[3][2] == 0 and len(got) == 54


def test_mix_without_ids(spark):
    """Documents without an id are drawn by their texts, so a source of these comes near its target, too."""
    rows = [(None, "a b c " + str(i), "s1") for i in range(400)] + [(i, "d e f g " + str(i), "s2") for i in range(400)] + [(900 + i, "x y z w " + str(i), "s3") for i in range(400)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum(F.col("_size") * F.col("_copies")).alias("taken"), F.first("_target").alias("target")).collect()
    assert all(abs(r["taken"] / r["target"] - 1) < 0.1 for r in got) and len(got) == 3
