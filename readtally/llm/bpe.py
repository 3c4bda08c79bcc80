"""Byte-pair encoding and decoding by dynamic programming over prefixes.

A text is cut into added tokens and pieces (words with the blank before them, numbers, signs, blanks), as the vocabulary's
byte-level pre-tokenizer does. Within a piece, an automaton over the vocabulary gives, for each prefix, the tokens that are
its suffixes. Exactly one of them ends the prefix's encoding: the one that is compatible with the last token of the prefix
before it, that is, no merge across their border would have come before the merges that made the two. That token is stored for
each prefix, and back-pointers from the piece's end give the ids that merging by rank gives.

Whether two tokens are compatible: their merges are undone, the later one first, and at each step the pair that meets at
the border must not have a merge that came before the two sides were merged away from it. Merges of one rank are made from
the left, so the border comes after a merge on its left and before one on its right.

Ids travel as binary columns (little-endian unsigned 32-bit integers). Pieces repeat, so each Python worker keeps the ids of
up to twice ``CACHED`` short ones (about 200 bytes each). The vocabulary (its file is 1 to 2 MB) is broadcast.

Edge cases: a null text is encoded as an empty one; rows may repeat; extra columns are kept, ``n_tokens``, ``ids`` and
``decoded`` replace columns of these names; an empty table gives an empty one. A long text is encoded in blocks of ``BLOCK`` pieces,
a piece's work is linear in its bytes (times the longest token), whatever its length. Bytes that are no UTF-8 are decoded as U+FFFD.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cached pieces of a worker, characters of the longest cached one, cached pairs and steps, and pieces of a block.
CACHED, LONGEST, PAIRS, BLOCK = 1 << 17, 64, 1 << 18, 1 << 16
# The pattern of the byte-level pre-tokenizer, and the letters and numbers that are younger than the Unicode
# version (16) of the tokenizer's pattern library.
_CLASSES = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{O}+|\s+(?!\S)|\s+"
YOUNGER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_YOUNG = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in YOUNGER)
PIECES = regex.compile(_CLASSES.format(L=r"\p{L}", N=r"\p{N}", O=r"[^\s\p{L}\p{N}]"))
_OLD_PIECES = regex.compile("(?V1)" + _CLASSES.format(L=rf"[\p{{L}}--[{_YOUNG}]]", N=rf"[\p{{N}}--[{_YOUNG}]]", O=rf"[[^\s\p{{L}}\p{{N}}]||[{_YOUNG}]]"))
_HAS_YOUNG = regex.compile(f"[{_YOUNG}]")
#: The same pattern on ASCII, where the plain library is quicker.
_ASCII_PIECES = re.compile(_CLASSES.replace(r"\s+(?!\S)|\s+", "[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").format(L="[A-Za-z]", N="[0-9]", O="[^\t-\r A-Za-z0-9]"))
_NEVER = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary's file: printable ones for themselves, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens with the merges that make them, from the JSON text of a tokenizer's file."""

    def __init__(self, text: bytes) -> None:
        spec = json.loads(text)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("not a byte-level BPE without normalizer and prefix space")
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("an option of the model is not supported")
        letters = byte_letters()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("an option of an added token is not supported")
        self.bytes: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        self.bytes |= {i: t.encode() for t, i in self.added.items()}
        ids = {t: i for t, i in model["vocab"].items()}
        size = max(self.bytes) + 1
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.pairs: dict[tuple[int, int], int] = {}
        made = {ids[c] for c in letters}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            t = ids[a + b]
            if self.rank[t] >= 0:
                raise ValueError(f"two merges make token {t}")
            a, b = ids[a], ids[b]
            self.rank[t], self.left[t], self.right[t], self.pairs[a, b] = r, a, b, r
            if a in made and b in made and self.compatible(a, b, r):
                made.add(t)
        #: Tokens that merging reaches: their own bytes are encoded as one token.
        self.whole = {self.bytes[i]: i for i in made}
        self._automaton()
        self.apart: dict[int, bool] = {}
        self.added_pattern = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.known = _Known(self)

    def _automaton(self) -> None:
        """States are prefixes of tokens. ``step``: the next state by state and byte, filled as bytes come. ``shorter``: the state
        of the longest proper suffix. ``ends``: the tokens that are suffixes of a state, longest first, with their lengths."""
        self.step: dict[int, int] = {}
        own, self.shorter, self.ends = [None], [0], [()]
        children: list[list[tuple[int, int]]] = [[]]
        for b, i in self.whole.items():
            state = 0
            for x in b:
                key = state << 8 | x
                if key not in self.step:
                    self.step[key] = len(own)
                    children[state].append((x, len(own)))
                    own.append(None), children.append([])
                state = self.step[key]
            own[state] = (i, len(b))
        self.shorter, self.ends = [0] * len(own), [()] * len(own)
        self.edges, todo = len(self.step), deque((0, x, s) for x, s in children[0])
        while todo:
            state, x, at = todo.popleft()
            if state:
                k = self.shorter[state]
                while k and (k << 8 | x) not in self.step:
                    k = self.shorter[k]
                self.shorter[at] = self.step.get(k << 8 | x, 0)
            self.ends[at] = ((own[at],) if own[at] else ()) + self.ends[self.shorter[at]]
            todo.extend((at, y, s) for y, s in children[at])

    def _next(self, state: int, x: int) -> int:
        k = state
        while k and (k << 8 | x) not in self.step:
            k = self.shorter[k]
        out = self.step.get(k << 8 | x, 0)
        if len(self.step) < self.edges + PAIRS:
            self.step[state << 8 | x] = out
        return out

    def _meet(self, a: int, b: int) -> bool:
        if len(self.apart) >= PAIRS:
            self.apart.clear()
        out = self.apart[a << 32 | b] = self.compatible(a, b)
        return out

    def compatible(self, a: int, b: int, before: int = _NEVER) -> bool:
        """Whether tokens a and b stay apart when merges up to the rank ``before`` are made."""
        end_a = end_b = before
        while True:
            r = self.pairs.get((a, b), _NEVER)
            if r < end_a and r <= end_b:
                return False
            if self.rank[a] > self.rank[b]:
                a, end_a = self.right[a], self.rank[a]
            elif self.rank[b] >= 0:
                b, end_b = self.left[b], self.rank[b]
            else:
                return True

    def encode_piece(self, piece: bytes) -> bytes:
        """Ids of a piece: the last token of each prefix, then the way back from the end."""
        if (one := self.whole.get(piece)) is not None:
            return one.to_bytes(4, "little")
        last, sizes = ([], []) if len(piece) <= LONGEST else (array("I"), array("I"))
        step, apart, ends, state = self.step, self.apart, self.ends, 0
        for i, x in enumerate(piece):
            to = step.get(state << 8 | x)
            state = self._next(state, x) if to is None else to
            for token, n in ends[state]:
                if n > i:
                    break
                before = last[i - n]
                ok = apart.get(before << 32 | token)
                if self._meet(before, token) if ok is None else ok:
                    break
            last.append(token)
            sizes.append(n)
        out, at = array("I"), len(piece) - 1
        while at >= 0:
            out.append(last[at])
            at -= sizes[at]
        out.reverse()
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def blocks(self, text: str, young: bool = True) -> Iterator[bytes]:
        """The ids of a text, in blocks. ``young``: whether it may hold letters of ``YOUNGER``."""
        parts = self.added_pattern.split(text) if self.added_pattern else [text]
        for i, part in enumerate(parts):
            if i % 2:
                yield self.added[part].to_bytes(4, "little")
                continue
            pattern = _ASCII_PIECES if part.isascii() else _OLD_PIECES if young and _HAS_YOUNG.search(part) else PIECES
            if len(part) <= BLOCK:
                yield b"".join(map(self.known.__getitem__, pattern.findall(part)))
                continue
            found = (m[0] for m in pattern.finditer(part))
            while some := list(islice(found, BLOCK)):
                yield b"".join(map(self.known.__getitem__, some))

    def encode(self, text: bytes) -> bytes:
        """The ids of a text in UTF-8."""
        young = bool((np.frombuffer(text, np.uint8) >= 0xD5).any())  # no letter of YOUNGER begins with a smaller byte
        return b"".join(self.blocks(text.decode("utf-8", "replace"), young))

    def decode(self, ids: bytes) -> str:
        """The text of ids; unknown ids are nothing."""
        reader, out = codecs.getincrementaldecoder("utf-8")("replace"), []
        for at in range(0, len(ids), 4 * BLOCK):
            block = np.frombuffer(ids, "<u4", min(BLOCK, (len(ids) - at) // 4), at).tolist()
            out.append(reader.decode(b"".join([self.bytes.get(i, b"") for i in block])))
        return "".join(out) + reader.decode(b"", True)


class _Known(dict):
    """Ids of pieces by text, in two generations: a full one becomes the older one, which is dropped then."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.vocabulary.encode_piece(piece.encode())
        if len(piece) <= LONGEST:
            if len(self) >= CACHED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(2)
def vocabulary(text: bytes) -> Vocabulary:
    return Vocabulary(text)


def load(spark: SparkSession, path: str):
    """Broadcast of a tokenizer's file, which the driver reads."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, tokenizer, text: str = "text") -> DataFrame:
    """Adds n_tokens and ids of the column ``text``. ``tokenizer``: of ``load``."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(tokenizer.value)
        for batch in batches:
            yield pa.array((v.encode(x.as_buffer().to_pybytes()) for x in batch), pa.binary(), size=len(batch))

    found = F.arrow_udf(run, "binary")(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))
    out = docs.withColumn("ids", found)
    return out.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode(encoded: DataFrame, tokenizer, ids: str = "ids") -> DataFrame:
    """Adds the text ``decoded`` of the column ``ids``, special tokens included."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(tokenizer.value)
        for batch in batches:
            yield pa.array((v.decode(x.as_buffer().to_pybytes()) for x in batch), pa.string(), size=len(batch))

    return encoded.withColumn("decoded", F.arrow_udf(run, "string")(F.coalesce(F.col(ids), F.lit(b""))))


def round_trip(docs: DataFrame, tokenizer, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass, so that a task has one Python worker: adds n_tokens, ids, decoded."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(tokenizer.value)
        for batch in batches:
            ids = [v.encode(x.as_buffer().to_pybytes()) for x in batch]
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([v.decode(x) for x in ids], pa.string())], names=["ids", "decoded"])

    found = F.arrow_udf(run, "struct<ids:binary,decoded:string>")(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))
    out = docs.withColumn("_bpe", found).withColumns({"ids": F.col("_bpe.ids"), "decoded": F.col("_bpe.decoded")}).drop("_bpe")
    return out.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def op11(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = load(spark, public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = round_trip(docs, tokenizer)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
