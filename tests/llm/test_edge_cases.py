"""Nulls, repeats, ties, long texts, clashing columns and empty tables, for every query and some operators."""

import pytest
from pyspark.sql import functions as F
from test_operators import text

from readtally.llm import chat, fingerprints, lines, queries, quality, shared, toxicity, warc

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, h string, gone int, _k string, node int, label int, words int, accepted int"
TABLES = {
    "documents": DOCUMENTS,
    "benchmark": "item_id long, text string, ik int, m int, h int",
    "labels": "doc_id long, quality int, toxic int, q int, good int",
    "pages": "page_id long, url string, html string, n int, sha1 int, first int, intact int",
    "conversations": "conv_id long, turn long, role string, text string, loss int, part int",
    "embeddings": "vec_id long, embedding array<float>, x int, n int, deviation int",
}
LONG = text(77, 60_000)


def rows():
    base = text(1, 150)
    docs = [(1, base), (1, base), (1, base), (2, base), (3, None), (None, None), (None, base), (None, text(2, 40)), (4, ""), (5, LONG), (6, LONG + " end"), (7, text(3, 30)), (7, text(4, 30)), (8, "\x00 \x01\x02 é 漢字 🙂"), (9, " \n\n ")]
    extra = {"documents": ["x", 1, "y", 2, 3, 4, 5], "benchmark": [1, 2, 3], "labels": [1, 2], "pages": [1, 2, 3, 4], "conversations": [1, 2], "embeddings": [1, 2, 3]}
    full = {
        "documents": [(i, t, None, None if i == 2 else "s", None) for i, t in docs],
        "benchmark": [(1, base), (1, base), (None, base), (2, None), (3, " ".join(LONG.split()[500:600]))],
        "labels": [(1, 1, 0), (1, 0, 1), (None, 1, 1), (7, None, None), (5, 0, 0)],
        "pages": [(1, None, "a"), (1, None, "a"), (2, "u", "a"), (None, "u", "a"), (None, None, None), (3, "http://x:bad/", "é" * 400_000), (4, "u", "")],
        "conversations": [(1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None), (2, 5, "assistant", LONG), (2, 5, "assistant", "b")],
        "embeddings": [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, 2.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [-0.0, 9.0])],
    }
    return {t: [(*r, *extra[t]) for r in full[t]] for t in full}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for name, content in (("full", rows()), ("none", dict.fromkeys(TABLES, []))):
        out[name] = str(tmp_path_factory.mktemp(name))
        for t, schema in TABLES.items():
            spark.createDataFrame(content[t], schema).coalesce(1).write.parquet(f"{out[name]}/{t}.parquet")
    return out


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, folders, name):
    got = queries.QUERIES[name](spark, folders["full"]).collect()
    none = queries.QUERIES[name](spark, folders["none"]).count()
    if name == "pipeline":
        assert none == 0 and {r["doc_id"] for r in got} <= {r[0] for r in rows()["documents"]}
    elif name.startswith("op4_"):
        assert sorted(r["conv_id"] for r in got if r["conv_id"] is not None) == [-7, 1, 2] and len(got) == 4 and none == 1
    elif name.startswith("op12_"):
        assert len(got) == 2 * 600 and none == 0 and all(r["kept"] + r["removed"] <= 16 for r in got) and {r["part"] for r in got} == {"", "s"}
    elif name.startswith("op13_"):
        # of two dimensions there are two components; rows that repeat a vector are all there
        assert sorted((str(r["vec_id"]), r["component"], r["n"]) for r in got) == sorted((i, k, 3) for i in ("1", "1", "None", "5") for k in (1, 2)) and none == 0
    else:
        table, key = ("pages", "page_id") if name.startswith("op10_") else ("documents", "doc_id")
        assert sorted(str(r[key]) for r in got) == sorted(str(r[0]) for r in rows()[table]) and none == 0


def test_repeated_rows_agree(spark, folders):
    """Rows that repeat a document get the same answer; the copies of document 1 link to each other."""
    for name in ("op1_importance_resampling", "op3_license_scan", "op5_toxicity_chain", "op6_line_chunk_dedup", "op7_benchmark_decontamination"):
        got = [tuple(r) for r in queries.QUERIES[name](spark, folders["full"]).where("doc_id = 1").collect()]
        assert len(got) == 3 and len(set(got)) == 1, name
    linked = queries.QUERIES["op9_ngram_jaccard_join"](spark, folders["full"]).where("doc_id <= 2").collect()
    assert all(r["n_links"] == 4 and r["class_id"] == 1 for r in linked)
    near = {r["doc_id"]: r for r in queries.QUERIES["op9_ngram_jaccard_join"](spark, folders["full"]).where("doc_id in (5, 6)").collect()}
    assert near[5]["class_id"] == near[6]["class_id"] == 5


def test_fingerprints_of_few_rows(spark):
    schema = "doc_id long, text string"
    one = spark.createDataFrame([(3, "a b c d e f")], schema)
    assert [r["next_text"] for r in fingerprints.with_next(one, ["text"]).collect()] == ["a b c d e f"]
    twice = spark.createDataFrame([(3, "a"), (3, "a"), (3, "b"), (None, "c"), (None, "d")], schema)
    nexts = sorted(r["text"] + r["next_text"] for r in fingerprints.with_next(twice, ["text"]).collect())
    # each text is followed by another row; put together the pairs visit all rows
    assert len(nexts) == 5 and sorted(x[1] for x in nexts) == sorted(x[0] for x in nexts)
    assert fingerprints.with_next(twice.limit(0), ["text"]).count() == 0


def test_machine_goes_on_after_errors(spark):
    turns = [(1, 0, "assistant", "x"), (1, 1, "user", "q"), (1, 2, "robot", "?"), (1, 3, "assistant", "a"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 0, "user", "q")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn_no"]): (r["allowed"], r["final"]) for r in chat.format_conversations(df).where("part = 1").collect()}
    assert [got[1, i][0] for i in range(4)] == [False, True, False, True] and got[1, 3][1] and got[2, 1] == (True, True) and got[3, 0] == (True, False)


def test_warc_least_bytes_and_changed_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(2, "u", ""), (1, "u", ""), (3, "u", "long enough"), (4, "u", "long enough")], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write(pages, path, least_bytes=5)
    entries = warc.read(spark, path)
    assert {r["page_id"]: r["record_type"] for r in entries.collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert all(r["intact"] for r in warc.checked(entries).collect())
    changed = entries.withColumn("payload_digest", F.when(F.col("page_id") == 3, "OTHER").otherwise(F.col("payload_digest")))
    assert {r["page_id"] for r in warc.checked(changed).where("not intact").collect()} == {4}


def test_classifiers_with_long_and_clashing(spark, folders):
    docs, labels = (spark.read.parquet(f"{folders['full']}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(docs, labels)
    assert out.columns[: len(docs.columns) - 1] == [c for c in docs.columns if c != "accepted"] and out.count() == docs.count()
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == docs.count()
    kept = lines.without_repeats(docs)
    assert kept.columns == [*docs.columns, "_removed", "_n_removed"] and {(r["h"], r["_k"]) for r in kept.collect()} == {("x", "y")}


def test_components_of_a_long_path(spark):
    edges = spark.range(3000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("a"), F.lpad((F.col("id") + 1).cast("string"), 6, "0").alias("b"))
    got = shared.components(edges).collect()
    assert len(got) == 3001 and {r["label"] for r in got} == {"000000"}


def test_shared_folder_is_asked_for(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = spark.conf, Context

    monkeypatch.setattr(spark.conf, "get", lambda key, default=None: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)
