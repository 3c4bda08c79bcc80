"""Whitening of embeddings by LOBPCG, the locally optimal block preconditioned conjugate gradient method (no preconditioner).

Vectors with null or non-finite entries go; an entry c becomes the integer floor(256 * c). The fit list holds each distinct
integer vector once. Its covariance V (divisor n) is never formed: a pass over the list multiplies V by a block of vectors, each
task adding up c (c' W) over its centred rows c, and Spark adding up the tasks' blocks. One round: an orthonormal basis of the
iterate, its residuals and the previous directions is multiplied by V, Rayleigh-Ritz on that basis gives the next iterate, residuals
and directions. Rounds end when the residuals |V x - e x| of all wanted components are certified: at most ``RESIDUAL`` times the
largest eigenvalue (or ``CERTIFIED`` times, if rounding keeps them from falling on). An eigenvalue lies within its residual of the
one reported.

Besides the wanted components a block has ``GUARD`` more vectors, which make the wanted ones converge sooner; up to 72 dimensions
the basis spans them all in the third round.

Rows are centred exactly up to one rounding: the mean is split into an integer and a fraction. The driver holds a few blocks
of (dimensions x basis) numbers, never rows.

Edge cases: rows that repeat a vector count once in the fit and each get rows; vectors shorter than the longest are filled up
with zeros; of components whose variance is below ``NONE`` of the largest (fewer distinct vectors than components, or one) none is
returned; equal eigenvalues give some basis of their space; no vectors, no rows; a null id stays. ``whiten`` keeps extra
columns and replaces those of its names. Integer vectors whose deviation exceeds 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readtally.llm.shared import discard, stored

COMPONENTS, GUARD, SEED, ROUNDS = 4, 20, 13, 300
#: Residuals over the largest eigenvalue: aimed at, needed; variance over the largest that counts as none.
RESIDUAL, CERTIFIED, NONE = 1e-14, 1e-12, 1e-12
#: Numbers of a row while tasks' matrices are added up.
LANES = 24


@dataclass
class Whitening:
    n: int
    total: list[int]  # sum of each dimension over the fit list
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # dimensions x components
    trace: float
    residuals: np.ndarray
    identity_error: float = 0.0

    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole numbers and fractions in [0, 1)."""
        return np.array([s // self.n for s in self.total], np.int64), np.array([s % self.n / self.n for s in self.total])

    def scaled(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def whole_numbers(vector: str | Column) -> Column:
    """floor(256 * c) of each entry; null for a vector that is null or has null or non-finite entries."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(F.forall(v, finite), F.transform(v, lambda c: F.floor(c.cast("double") * 256).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _centred(column: pa.Array, mean: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (_matrix(column) - mean[0]).astype(np.float64) - mean[1]


def _sums(fit: DataFrame, width: int, task: Callable[[Iterator[pa.Array]], np.ndarray | None], kind: str = "double") -> np.ndarray:
    """The sum over tasks of the matrices (``width`` columns) that ``task`` makes of its vectors. Spark adds them up in rows of ``LANES`` numbers."""
    lanes = min(width, LANES)
    names = [f"v{j}" for j in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = task(b.column("x") for b in batches if b.num_rows)
        if made is not None:
            rows = np.pad(made, ((0, 0), (0, -width % lanes))).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)).astype(np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], names=["i", *names])

    rows = fit.mapInArrow(run, ", ".join(["i int", *(f"{c} {kind}" for c in names)])).groupBy("i").agg(*(F.sum(c).alias(c) for c in names))
    found = np.array([tuple(r)[1:] for r in rows.orderBy("i").collect()])  # as many numbers as one task's matrix
    return found.reshape(-1, width + -width % lanes)[:, :width]


def _totals(fit: DataFrame) -> list[int]:
    def totals(columns: Iterator[pa.Array]) -> np.ndarray | None:
        out = None
        for c in columns:
            x = _matrix(c)
            halves = np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)], 1)
            out = halves if out is None else out + halves
        return out

    return [int(high) * (1 << 32) + int(low) for high, low in _sums(fit, 2, totals, "long")]


def _product(fit: DataFrame, n: int, mean: tuple[np.ndarray, np.ndarray], block: np.ndarray) -> tuple[np.ndarray, float]:
    """V times ``block`` (dimensions x vectors), and the trace of V."""
    sent = fit.sparkSession.sparkContext.broadcast((mean, block))

    def product(columns: Iterator[pa.Array]) -> np.ndarray | None:
        out, squares = None, 0.0
        for column in columns:
            c = _centred(column, sent.value[0])
            part = c.T @ (c @ sent.value[1])
            squares += float((c * c).sum())
            out = part if out is None else out + part
        return None if out is None else np.vstack([out, np.full((1, out.shape[1]), squares)])

    found = _sums(fit, block.shape[1], product) / n
    sent.destroy()
    return found[:-1], float(found[-1, 0])


def _orthonormal(*blocks: np.ndarray) -> np.ndarray:
    """An orthonormal basis of all columns; directions that the earlier blocks hold, up to rounding, are left out."""
    basis = np.linalg.qr(blocks[0])[0]
    for b in blocks[1:]:
        b = b / np.maximum(np.linalg.norm(b, axis=0), np.finfo(float).tiny)
        for _ in range(2):
            b = b - basis @ (basis.T @ b)
        u, s, _ = np.linalg.svd(b, full_matrices=False)
        u = u[:, s > 1e-8]
        u = u - basis @ (basis.T @ u)
        basis = np.hstack([basis, np.linalg.qr(u)[0]])
    return basis


def eigenpairs(product: Callable[[np.ndarray], tuple[np.ndarray, float]], size: int, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Largest eigenvalues, their vectors, certified residuals and the trace of the matrix that ``product`` multiplies by."""
    wanted, width = min(wanted, size), min(wanted + GUARD, size)
    basis = _orthonormal(np.random.default_rng(SEED).standard_normal((size, width)))
    best, waited = np.inf, 0
    for _ in range(ROUNDS):
        image, trace = product(basis)
        inner = basis.T @ image
        values, mix = np.linalg.eigh((inner + inner.T) / 2)
        values, mix = values[::-1][:width], mix[:, ::-1][:, :width]
        iterate = basis @ mix
        residual = image @ mix - iterate * values
        norms = np.linalg.norm(residual[:, :wanted], axis=0)
        worst = norms.max() / values[0] if values[0] > 0 else 0.0
        waited = 0 if worst < best / 2 else waited + 1
        best = min(best, worst)
        if worst <= RESIDUAL or worst <= CERTIFIED and waited >= 2:
            return values[:wanted], iterate[:, :wanted], norms, trace
        direction = basis[:, width:] @ mix[width:]
        basis = _orthonormal(iterate, residual, direction) if direction.any() else _orthonormal(iterate, residual)
    raise RuntimeError("whitening: the residuals do not fall")


def fit_list(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """Stored table of the distinct integer vectors (column x), all of one length."""
    x = embeddings.select(whole_numbers(vector).alias("x")).where("x is not null")
    fit = stored(x.distinct(), "whitening-fit", "zstd")
    least, most = fit.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least == most:
        return fit
    padded = stored(fit.select(filled(F.col("x"), most or 0).alias("x")).distinct(), "whitening-fit", "zstd")
    discard(fit)
    return padded


def filled(x: Column, size: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size(x)))


def fit(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the vectors; None if there are none, or only empty ones."""
    rows = fit_list(embeddings, vector)
    n = rows.count()
    total = _totals(rows) if n else []
    if not total:
        discard(rows)
        return None
    out = Whitening(n, total, np.empty(0), np.empty((len(total), 0)), 0.0, np.empty(0))
    mean = out.mean()
    values, vectors, residuals, out.trace = eigenpairs(lambda block: _product(rows, n, mean, block), len(total), components)
    real = (values > NONE * values[0]) & (values > 0)
    out.values, out.vectors, out.residuals = values[real], vectors[:, real], residuals[real]
    if real.any():
        out.identity_error = _identity_error(rows, out)
    discard(rows)
    return out


def _identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity, by a pass of its own."""
    mean, scaled = model.mean(), model.scaled()

    def moments(columns: Iterator[pa.Array]) -> np.ndarray | None:
        out = None
        for column in columns:
            w = _centred(column, mean) @ scaled
            part = np.vstack([w.T @ w, w.sum(0)])
            out = part if out is None else out + part
        return out

    found = _sums(rows, scaled.shape[1], moments) / model.n
    return float(np.abs(found[:-1] - np.outer(found[-1], found[-1]) - np.eye(scaled.shape[1])).max())


def whiten(embeddings: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The rows that remain, with deviation (sum over dimensions of (n * x - S) ** 2, exact) and whitened (an array)."""
    sent = embeddings.sparkSession.sparkContext.broadcast((model.n, model.total, model.mean(), model.scaled()))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        n, total, mean, scaled = sent.value
        least = min(abs(s) for s in mean[0].tolist())
        rest = np.array([s - n * int(q) for s, q in zip(total, mean[0], strict=True)], np.int64)  # from 0 to n - 1
        for batch in batches:
            if not len(batch):
                yield pa.array([], _KIND)
                continue
            x = _matrix(batch)
            far = max(abs(int(x.max())), abs(int(x.min())), int(np.abs(mean[0]).max()), least)
            if len(total) * (2 * n * (far + 1)) ** 2 < 1 << 63:
                d = n * (x - mean[0]) - rest
                deviation = pa.array((d * d).sum(1))
            else:
                exact = [sum((n * a - s) ** 2 for a, s in zip(row, total, strict=True)) for row in x.tolist()]
                if max(exact) >= 1 << 63:
                    raise OverflowError("a deviation exceeds 64 bits")
                deviation = pa.array(exact, pa.int64())
            w = _centred(batch, mean) @ scaled
            offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.StructArray.from_arrays([deviation, pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], names=["deviation", "whitened"])

    x = filled(whole_numbers(vector), len(model.total))
    kept = embeddings.withColumn("_x", x).where("_x is not null")
    out = kept.withColumn("_w", F.arrow_udf(run, "struct<deviation:long,whitened:array<double>>")("_x")).drop("_x")
    return out.withColumns({"deviation": F.col("_w.deviation"), "whitened": F.col("_w.whitened")}).drop("_w")


_KIND = pa.struct([("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"


def op13(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = fit(rows)
    if model is None:
        return spark.createDataFrame([], OUT)
    out = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    numbers = lambda values: F.get(F.array(*(F.lit(float(v)) for v in values)), F.col("k"))
    return out.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        numbers(model.values / model.trace if model.trace else []).alias("explained"), F.lit(model.identity_error).alias("identity_error"), numbers(model.residuals).alias("residual"),
    )
