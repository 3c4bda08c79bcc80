"""The ten operators against brute-force versions, with nulls, empty and long texts, repeats and clashing columns."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from readtally.llm import chat, decontaminate, fingerprints, jaccard, licenses, lines, mixing, quality, shared, toxicity, warc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _k string, h string, gone int"


def words(t):
    return WORD.findall((t or "").translate(LOW))


def text(seed, n):
    out, x = [], seed
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(f"w{x >> 53}é"[: 3 + (x >> 40) % 4])
    return " ".join(out)


def corpus():
    base = text(1, 120)
    rows = [(1, base), (2, base), (3, base + " one more"), (4, None), (5, ""), (6, "Two Words"), (7, "two words!"), (8, text(2, 9000)), (9, text(3, 40)), (9, text(4, 40)), (1, base), (None, text(5, 30)), (10, base.replace(" ", "\n", 3)), (11, text(6, 60) + " " + " ".join(base.split()[:13]) + " x"), (12, "\x01 mark\n" + text(7, 20))]
    return [(i, t, None, None if i == 9 else f"s{(i or 0) % 3}", None, "x", "y", 1) for i, t in rows]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_jaccard(spark, docs, none):
    rows = [(i, words(t)) for i, t, *_ in corpus()]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset()) for _, w in rows]
    linked = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b)
    links = collections.Counter((rows[i][0], sum(linked(sets[i], sets[j]) for j in range(len(rows)) if j != i)) for i in range(len(rows)))
    got = jaccard.near_duplicates(docs).collect()
    assert collections.Counter((r["doc_id"], r["n_links"]) for r in got) == links
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] in (1, 2, 3, 10, 7)} == {1: 1, 2: 1, 3: 1, 10: 1, 7: 6}
    kept = jaccard.stage(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 4, 5, 6, 8, 9, 9, 11, 12]
    assert jaccard.near_duplicates(none).count() == 0


def test_jaccard_blocks(spark, monkeypatch):
    """Groups larger than a block lose no link."""
    monkeypatch.setattr(jaccard.in_blocks, "__defaults__", (8, None))
    base = text(11, 100).split()
    near = spark.createDataFrame([(i, " ".join(base[:i] + ["zz"] + base[i + 1 :])) for i in range(40)], "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(near).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ([*base[:i], "zz", *base[i + 1 :]] for i in range(40))]
    assert got == {i: (0, sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1) for i, a in enumerate(sets)}


def test_decontamination(spark, docs, none):
    base = text(1, 120).split()
    items = [(1, " ".join(base[:13])), (2, " ".join(base[50:75]).upper()), (3, "two words"), (4, None), (5, " ... "), (3, "two words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(len(w) - min(13, len(w)) + 1 if w else 0):
            wins[tuple(w[k : k + min(13, len(w))])].add(i)
    want = collections.Counter()
    for d, t, *_ in corpus():
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in wins}:
            for k in range(len(w) - m + 1):
                if x := wins.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    found |= x
        want[(d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest())] += 1
    for prefilter in (decontaminate.PREFILTER, 0):
        got = decontaminate.contamination(docs, bench, prefilter).collect()
        assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got) == want
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_line_chunks(spark, none):
    passage = [f"Line {i} says {text(i, 6)}." for i in range(40)]
    texts = ["\n".join([f"own {d}.", *passage, f"end {d}."]) for d in range(3)] + ["\n".join(passage[:2]), None, "", "one line", "a\x01b\n" + "\n".join(passage[5:30])]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, gone int")
    got = {r["doc_id"]: r["text"] for r in lines.without_repeats(docs).collect()}
    assert got[0] == texts[0] and got[4] is None and got[5] == "" and got[6] == "one line"
    for d in (1, 2):
        assert len(got[d]) < 0.4 * len(texts[d]) and f"own {d}." in got[d] and f"end {d}." in got[d]
    assert got[7].startswith("a\x01b\n") and len(got[7]) < len(texts[7])
    assert lines.without_repeats(none).count() == 0


@pytest.mark.parametrize("sentences", range(1, 7))
def test_line_passages_inside_other_text(spark, sentences):
    rows, want = [], []
    for n in (51, 60, 75, 100):
        passage = text(1000 * sentences + n, n).split(" ")
        for k in range(1, sentences):
            passage[k * n // sentences - 1] += "."
        for d in range(3):
            own = text(7919 * len(rows) + sentences, 90).split(" ")
            at = (37 * len(rows) + 11 * sentences) % 80
            rows.append((len(rows), " ".join(own[:at] + passage + own[at:]), 0))
            want.append((own, at, n, d))
    got = {r["doc_id"]: r["text"] for r in lines.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, gone int")).collect()}
    for i, (own, at, n, d) in enumerate(want):
        lost = len(rows[i][1].split()) - len(got[i].split())
        assert lost == 0 if d == 0 else n - 30 <= lost <= n
        assert got[i].startswith(" ".join(own[:at])) and got[i].endswith(" ".join(own[at:]))


def test_line_passages_unspaced_and_short(spark):
    passage = "".join(chr(0x4E00 + (i * i * 31 + i * 7) % 5000) for i in range(80))
    phrase = text(77, 12)
    texts = ["甲乙丙" + passage + "丁戊", "some words before " + passage + " and after", text(1, 40) + " " + phrase, text(2, 40) + " " + phrase + " " + text(3, 40)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, gone int")
    got = {r["doc_id"]: r["text"] for r in lines.without_repeats(docs).collect()}
    assert got[0] == texts[0] and got[2] == texts[2] and got[3] == texts[3]
    assert got[1].startswith("some words before ") and got[1].endswith(" and after") and len(got[1]) < 60


def test_cut(spark):
    texts = [text(5, 400), "a\x01b\x02 \x02a " + text(5, 400) + " \x01", "", " ", "\n\n a  b \n", text(5, 200).replace(" ", "\n"), "漢" * 30 + "".join(chr(0x4E00 + i * 97 % 5000) for i in range(90)) + " end"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", lines.cut(F.col("text")).alias("c"), lines.n_words(F.col("text")).alias("m")).collect()
    assert all("".join(x for x in r["c"]) == r["text"] for r in rows)
    chunks = [r["c"] for r in rows]
    assert [r["m"] for r in rows] == [400, 403, 0, 0, 2, 200, 124]
    assert len(chunks[0]) > 40 and len(chunks[6]) > 8 and set(chunks[0][1:-2]) <= set(chunks[1])


def test_mixing(spark, docs, none):
    out = mixing.mixed(docs).collect()
    assert len(out) == 15 and all(0 <= r["_copies"] <= 2 for r in out)
    total = sum(r["_size"] for r in out)
    targets = {r["source"]: (r["_source_size"], r["_target"]) for r in out}
    assert abs(sum(t for _, t in targets.values()) - 1.5 * total) < 1e-6 and all(t <= 2 * s for s, t in targets.values())
    assert sorted(mixing.mixed(docs).select("doc_id", "_copies").collect(), key=str) == sorted(((r["doc_id"], r["_copies"]) for r in out), key=str)
    assert mixing.stage(spark, none, "").count() == 0


def test_quality(spark, docs, none):
    good = [(i, text(i, 80)) for i in range(100)]
    bad = [(i, text(i, 80).replace(" ", "$$$ ")) for i in range(100, 130)]
    table = spark.createDataFrame([*good, *bad, (None, "x"), (999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in range(0, 130, 2)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["accepted"] for r in quality.classify(table, labels).collect()}
    assert all(got[i] for i in range(100)) and not any(got[i] for i in range(100, 130)) and got[999]
    assert quality.classify(none, labels).count() == 0
    assert quality.classify(docs, labels.limit(0)).where("accepted").count() == 15


def test_kth_largest(spark):
    df = spark.range(5000).select((F.col("id") % 700).cast("double").alias("x"))
    values = sorted((float(i % 700) for i in range(5000)), reverse=True)
    for k in (1, 7, 8, 3000, 5000):
        assert quality._kth_largest(df, "x", k, bins=16, most=3) == values[k - 1]


def test_toxicity(spark, none):
    rows = [(i, text(i, 60) + (" idiot scum moron" if i % 10 == 0 else "")) for i in range(400)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs, chain).collect()}
    assert all(got[i] == (i % 10 == 0) for i in range(300, 400)) and not got[1000] and not got[1001]
    assert toxicity.score(none, chain).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels.where("toxic > 5"))).where("toxic").count() == 0


def test_licenses(spark, docs, none):
    texts = [None, "", "CC-BY cc by", "GNU General Public License; all rights reserved. All Rights Reserved", "Licensed under the Apache License, Version 2.0.", "cc", "public license", "by cc", text(1, 20000) + " all rights reserved"]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    for i, t in enumerate(texts):
        w = words(t)
        at = [(k, n) for n, p in phrases.items() for k in range(len(w)) if w[k : k + len(p)] == p]
        want = (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({n for _, n in at})))
        assert tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == want
    assert got[4]["labels"] == "apache-2.0" and got[4]["score"] == 1.0
    assert licenses.scan(none).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a\\</s>[INST] \\\\[/INST]"), (1, 1, "assistant", " [ROLE x] \\"), (2, 0, "assistant", None), (2, 0, "assistant", "b"), (3, 0, "tool\n", ""), (3, 1, None, "n"), (None, 5, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for conv in (1, 2, 3, None):
        turns = [(role or "", t or "") for c, _, role, t in rows if c == conv]
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [got[c]["well_formed"] for c in (1, 2, 3)] == [True, False, False]
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_fingerprints(spark, docs):
    rows = [(i, text(i, n)) for i, n in ((1, 300), (2, 4), (5, 18), (9, 21))] + [(3, None), (4, ""), (7, "漢" * 60), (None, text(9, 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(g["hash"], g["position"]) for g in r["fingerprint_grams"]] for r in fingerprints.fingerprint(df).collect()}
    assert got[3] == got[4] == [] and len(got[2]) == 1 and len(got[7]) >= 1
    # every 20 shared tokens share a gram
    long = text(1, 300).split()
    cut = spark.createDataFrame([(1, " ".join(["q"] * 30 + long[100:120] + ["r"] * 30))], "doc_id long, text string")
    assert {h for h, _ in got[1]} & {g["hash"] for g in fingerprints.fingerprint(cut).first()["fingerprint_grams"]}
    order = [9, 7, 5, 4, 3, 2, 1, None]
    nexts = {r["doc_id"]: r["next_doc_id"] for r in fingerprints.with_next(df, ["doc_id"]).collect()}
    assert nexts == {d: order[(i + 1) % len(order)] for i, d in enumerate(order)}


def test_warc(spark, tmp_path):
    pages = [(3, "http://www.b.org/x", "same"), (1, "https://b.org/x/", "same"), (2, "http://a.org:8080/?q=1", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n"), (4, None, None), (5, "http://a.org/\r\nX: y", ""), (6, "c", "é" * 5000)]
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), path, records_per_file=2)
    got = warc.capture_index(warc.read(spark, path)).collect()
    assert {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got} == {1: ("response", None, 4), 3: ("revisit", 1, 4), 2: ("response", None, 33), 4: ("response", None, 0), 5: ("revisit", 4, 0), 6: ("response", None, 10000)}
    assert all(r["intact"] for r in got) and warc.url_key("http://www.b.org/x") == warc.url_key("https://b.org/x/") == "org,b)/x"
    keys = [(r["url_key"], r["capture_time"]) for r in got]
    assert keys == sorted(keys)


@pytest.mark.parametrize("runs", [[], [[]], [[1, 4], [], [2, 2, 9], [0]], [[3], [1], [2], [5], [4]]])
def test_loser_tree(runs):
    assert list(warc.loser_tree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_small_counts_array_elements(spark):
    df = spark.createDataFrame([(1, list(range(8))), (2, [])], "a long, gone array<int>")
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(shared.small(df, 3, "gone")) and not hinted(shared.small(df, 2, "gone")) and hinted(shared.small(df, 2)) and not hinted(shared.small(df, 1))
