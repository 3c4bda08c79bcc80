"""Byte-pair encoding against the tokenizers library, and against merging by rank."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readtally.llm import bpe

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return bpe.Vocabulary(f.read())


def ids(v, text):
    return np.frombuffer(v.encode(text.encode()), "<u4").tolist()


PARTS = st.sampled_from(["a", "b", "e", "t", "h", " ", "  ", "in", "the", "er", "1", "23", ".", ",", "'s", "\n", "\x85", "\x1c", "é", "漢", "🙂", "A", "́", "࢏", "՘", "<|endoftext|>", " "])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.lists(PARTS, max_size=30).map("".join), st.text(max_size=60), st.text("ab", max_size=60)))
def test_as_the_library(library, vocabulary, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(vocabulary, text) == want
    assert vocabulary.decode(vocabulary.encode(text.encode())) == library.decode(want, skip_special_tokens=False)


def merged(v, piece):
    """Plain merging: the pair of lowest rank first, from the left."""
    out = [v.whole[bytes([x])] for x in piece]
    while len(out) > 1:
        r, i = min((v.pairs.get(p, 1 << 60), i) for i, p in enumerate(zip(out, out[1:], strict=False)))
        if r == 1 << 60:
            break
        a, b = out[i : i + 2]
        out[i : i + 2] = [next(t for t in (v.whole.get(v.bytes[a] + v.bytes[b]),) if t is not None)]
    return out


def test_as_merging(vocabulary):
    x = 1
    for n in range(1, 60):
        for letters in (b"ab", b"aeinrst", b" -=", bytes(range(256))):
            piece = b""
            for _ in range(n):
                x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
                piece += letters[(x >> 33) % len(letters) :][:1]
            got = np.frombuffer(vocabulary.encode_piece(piece), "<u4").tolist()
            assert got == merged(vocabulary, piece)


def test_caches_that_overflow(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 5)
    monkeypatch.setattr(bpe, "PAIRS", 7)
    monkeypatch.setattr(bpe, "BLOCK", 3)
    with open(PATH, "rb") as f:
        v = bpe.Vocabulary(f.read())
    text = "the quick brown fox jumps over the lazy dog, 1234 times; the <|endoftext|> fox isn't quick\n\n" * 3
    assert ids(v, text) == library.encode(text, add_special_tokens=False).ids and v.decode(v.encode(text.encode())) == text


def test_operator(spark, library):
    word = "abcdefgh" * 40_000
    rows = [(1, None, "x"), (2, "", "x"), (2, "a b", "x"), (2, "a b", "x"), (None, "z" * 5000 + "<|endoftext|>", "x"), (3, word, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(2)
    t = bpe.load(spark, PATH)
    got = sorted(((r["doc_id"] or 0, r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in bpe.decode(bpe.encode(df, t), t).collect()), key=str)
    plain = [(i or 0, library.encode(x or "", add_special_tokens=False).ids, x or "") for i, x, _ in rows]
    assert got == sorted(((i, len(w), np.array(w, "<u4").tobytes(), x) for i, w, x in plain), key=str)
    assert bpe.decode(bpe.encode(df.limit(0), t), t).count() == 0
    both = bpe.round_trip(df, t)
    assert sorted(((r["doc_id"] or 0, r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in both.collect()), key=str) == got


def test_query(spark, library, tmp_path):
    texts = [None, "", "one two", "é漢字 " * 300]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.op11(spark, str(tmp_path)).collect()}
    for i, x in enumerate(texts):
        want = library.encode(x or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i] == (len(want), digest, hashlib.sha256((x or "").encode()).hexdigest())


def test_refused_files():
    import json

    with open(PATH, "rb") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"model": spec["model"] | {"ignore_merges": True}}):
        with pytest.raises(ValueError):
            bpe.Vocabulary(json.dumps(spec | change).encode())
