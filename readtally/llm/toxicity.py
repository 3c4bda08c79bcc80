"""Toxicity by a classifier chain.

Categories are predicted one after the other. Each is a linear model over hashed words and 5-byte pieces of words
(present or not); from the second on it also sees the probabilities of the earlier ones. While training, these
probabilities are out-of-fold, so later models learn from errors like those they will meet.

The labels hold one judgement (toxic), so the narrower categories come from the toxic texts of the sample: 2-means over their
telling features parts these into two kinds, and the chain is kind_1 -> kind_2 -> toxic. A row's kind is a target only; features and
out-of-fold probabilities come from the other folds. Models are trained on the driver from a bounded sample of
labelled rows (``POSITIVE`` toxic and ``NEGATIVE`` others, by hash of the id); every document is scored whole.

Edge cases: null and empty texts have no features and score by intercept; without toxic labels all probabilities
are 0; each row gives a row, repeated or not. A very long text is a slice of its own in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readtally.llm import vectors as V
from readtally.llm.shared import stored, text_hash

BITS, PIECE = 20, 5
POSITIVE, NEGATIVE = 2_000, 3_000
FEATURES, LEAST_Z, FOLDS = 2_048, 3.5, 3
#: Share of documents labelled as not toxic that must stay below the cut, out of fold.
CALM = 0.998
NAMES = ["kind_1", "kind_2", "toxic"]


def _features(w: V.Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each feature that occurs (not distinct)."""
    shift = np.uint64(64 - BITS)
    data, n = w.data, len(w.data) - PIECE + 1
    if n <= 0:
        return w.row, (w.hash >> shift).astype(np.int64)
    p, down = V.prefix_hash(data)
    letter = data != 0
    run = letter[1 : n + 1].copy()
    for j in range(2, PIECE):
        run &= letter[j : n + j]
    at = np.flatnonzero(run)  # the first byte may be the gap before a word
    h = V.mix((p[at + PIECE] - p[at]) * down[at] + np.uint64(PIECE << 32)) >> shift
    row = np.searchsorted(w.bounds, at + PIECE - 1, side="right") - 1
    inside = w.bounds[row] <= at  # not across rows
    whole = (w.hash >> shift).astype(np.int64)
    return np.concatenate([w.row, row[inside]]), np.concatenate([whole, h[inside].astype(np.int64)])


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for w in V.words(batch.column("text")):
            row, f = _features(w)
            pair = np.unique(row * (1 << BITS) + f)
            bounds = np.searchsorted(pair, np.arange(w.n_rows + 1) << BITS)
            found += [(pair[bounds[r] : bounds[r + 1]] & ((1 << BITS) - 1)).astype(np.int32).tobytes() for r in range(w.n_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], names=["doc_id", "toxic", "features"])


@dataclass
class Chain:
    names: list[str]
    known: np.ndarray  # sorted feature numbers
    weights: np.ndarray  # categories x features
    earlier: np.ndarray  # categories x categories, weights of earlier probabilities
    bias: np.ndarray
    cut: float  # least probability of the last category that counts as toxic


def _linear(x: np.ndarray, y: np.ndarray, rounds: int = 120, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression with an intercept (last weight) by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32)
    w, v = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    step = np.float32(4 / max(1.0, float((x * x).sum(axis=1).mean())))
    for i in range(rounds):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ v, -40, 40))) - y).astype(np.float32) / len(x) + ridge * np.append(v[:-1], 0).astype(np.float32)
        new = v - step * g
        v = new + np.float32(i / (i + 3)) * (new - w)
        w = new
    return w


def _telling(flat: np.ndarray, owner: np.ndarray, toxic: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Sorted numbers of the features whose odds are highest in the toxic rows among ``use``."""
    mine = use[owner]
    a = np.bincount(flat[mine & toxic[owner]], minlength=1 << BITS) + 0.5
    b = np.bincount(flat[mine & ~toxic[owner]], minlength=1 << BITS) + 0.5
    ra, rb = (toxic & use).sum() + 1 - a, (~toxic & use).sum() + 1 - b
    z = (np.log(a / ra) - np.log(b / rb)) / np.sqrt(1 / a + 1 / b + 1 / ra + 1 / rb)
    known = np.argsort(-z, kind="stable")[:FEATURES]
    return np.sort(known[z[known] >= LEAST_Z])


def _present(flat: np.ndarray, owner: np.ndarray, n: int, known: np.ndarray) -> np.ndarray:
    at = V.in_sorted(flat, known)
    x = np.zeros((n, len(known)), np.float32)
    x[owner[at >= 0], at[at >= 0]] = 1
    return x


def _second_kind(x: np.ndarray, rounds: int = 20) -> np.ndarray:
    """2-means by cosine over the toxic rows, from the first row and the one least like it; the larger kind is the first."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centre = np.stack([x[0], x[np.argmin(x @ x[0])]])
    second = np.zeros(len(x), bool)
    for _ in range(rounds):
        near = x @ centre.T
        second = near[:, 1] > near[:, 0]
        if second.all() or not second.any():
            break
        centre = np.stack([x[~second].mean(axis=0), x[second].mean(axis=0)])
    return second if 2 * second.sum() <= len(x) else ~second


def train(rows: list, folds: int = FOLDS) -> Chain | None:
    """rows: (doc_id, toxic, feature bytes), in a fixed order."""
    toxic = np.array([r[1] > 0 for r in rows], bool)
    if not len(rows) or toxic.all() or not toxic.any():
        return None
    lists = [np.frombuffer(r[2], np.int32) for r in rows]
    flat, owner = np.concatenate(lists), np.repeat(np.arange(len(rows)), [len(x) for x in lists])
    fold = np.arange(len(rows)) % folds
    # features are chosen without the fold whose probabilities they serve; ``folds`` stands for the models of all rows
    chosen = [_telling(flat, owner, toxic, fold != k) for k in range(folds + 1)]
    known = chosen[folds]
    second = np.zeros(len(rows), bool)
    second[toxic] = _second_kind(_present(flat, owner, len(rows), known)[toxic])
    y = np.column_stack([toxic & ~second, second, toxic])
    n, m = len(NAMES), len(known)
    weights, earlier, bias, held = np.zeros((n, m)), np.zeros((n, n)), np.zeros(n), np.zeros((len(rows), n), np.float32)
    for c in range(n):
        for k in range(folds + 1):
            seen = np.hstack([_present(flat, owner, len(rows), chosen[k]), held[:, :c]])
            w = _linear(seen[fold != k], y[fold != k, c])
            if k == folds:
                weights[c], earlier[c, :c], bias[c] = w[:m], w[m:-1], w[-1]
            else:  # out-of-fold probabilities for the later models and for the cut
                new = 1 / (1 + np.exp(-np.clip(seen[fold == k] @ w[:-1] + w[-1], -40, 40)))
                held[fold == k, c] = new
    # between what all but a few of the other documents stay below and the toxic ones above that
    calm = float(np.quantile(held[~toxic, -1], CALM))
    above = held[toxic, -1][held[toxic, -1] > calm]
    cut = min(0.5, (calm + float(np.quantile(above, 0.05))) / 2) if len(above) else 0.5
    return Chain(NAMES, known, weights, earlier, bias, cut)


def fit(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE) -> Chain | None:
    told = stored(labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic-labels")
    by_hash = [F.xxhash64("doc_id"), "doc_id"]
    sample = told.where("toxic > 0").orderBy(*by_hash).limit(positive).unionByName(told.where("toxic <= 0").orderBy(*by_hash).limit(negative))
    sample = stored(sample, "toxic-sample")  # at most positive + negative rows, so it may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    # a row for each sampled id; of an id's texts the one of the least hash
    texts = texts.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min_by("text", text_hash()).alias("text"))
    rows = texts.mapInArrow(_sample_features, "doc_id long, toxic int, features binary").collect()
    return train(sorted((r["doc_id"], r["toxic"], bytes(r["features"])) for r in rows))


def _score(chain: Chain | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = NAMES
        for batch in batches:
            p = np.zeros((batch.num_rows, len(names)))
            if chain:
                slot = np.full(1 << BITS, -1, np.int32)
                slot[chain.known] = np.arange(len(chain.known))
                for w in V.words(batch.column("text")):
                    row, f = _features(w)
                    f = slot[f]
                    row, f = row[f >= 0], f[f >= 0]
                    pair = np.unique(row * len(chain.known) + f)
                    row, f = pair // len(chain.known), pair % len(chain.known)
                    z = [np.bincount(row, chain.weights[c, f], w.n_rows) for c in range(len(names))]
                    part = p[w.first : w.first + w.n_rows]
                    for c in range(len(names)):
                        part[:, c] = 1 / (1 + np.exp(-np.clip(z[c] + part[:, :c] @ chain.earlier[c, :c] + chain.bias[c], -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(p[:, c]) for c in range(len(names))), pa.array(p[:, -1] >= (chain.cut if chain else 1.0))], names=["doc_id", *(f"p_{c}" for c in names), "toxic"])

    return run


def score(docs: DataFrame, chain: Chain | None) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_score(chain), "doc_id long, " + ", ".join(f"p_{c} double" for c in NAMES) + ", toxic boolean")


def op5(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))
