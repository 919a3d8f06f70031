"""Embedding whitening by incremental eigendecomposition.

Each part of the vectors keeps the spectrum of its scatter matrix. A vector is a centred rank-one update of it; a block of
more vectors than dimensions is brought to as many centred rows as dimensions first (the triangle of its QR decomposition,
which has the same scatter), each of them an update. The secular equation gives the new eigenvalues, with deflation where
an entry of the update or a gap between eigenvalues vanishes, and the eigenvectors turn along. Spectra of parts are
combined by rank-one updates too: one for each eigenpair, one for the means. A last pass over all vectors projects them on
the combined eigenvectors and settles these by Rayleigh-Ritz.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tacgrid.llm.base import map_arrow, materialise, table

#: Entries are floor(SCALE * value).
SCALE = 256.0
#: Vectors of one task, and of a block that it takes up together; spectra that one task combines.
ROWS_PER_PART, BLOCK_ROWS, SPECTRA_PER_TASK = 1 << 16, 2048, 32
COMPONENTS = 4
EPS = np.finfo(np.float64).eps
#: Eigenvalues below this share of the largest are rounding: the direction has no spread.
FLAT = 1e-11


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z2 / (d - x)) for rising d and positive z2, each as (pole that it is measured from, distance).

    A root lies after each pole. It is measured from the nearer of its two poles, so that differences to poles are exact.
    Rational interpolation between both poles, bisection where that leaves the bracket.
    """
    n, i = len(d), np.arange(len(d))
    after = np.append(d[1:], d[-1] + z2.sum())
    middle = d + (after - d) / 2
    left = 1 + (z2 / (d - middle[:, None])).sum(1) >= 0
    left[-1] = True
    origin = np.where(left, i, np.minimum(i + 1, n - 1))
    gap = d - d[origin][:, None]  # poles as seen from each root's origin
    near, far = d - d[origin], after - d[origin]
    low, high = near.copy(), far.copy()
    low[~left] = middle[~left] - d[origin[~left]]
    high[left & (i < n - 1)] = (middle - d[origin])[left & (i < n - 1)]
    x = low + (high - low) / 2
    lower = i[None, :] <= i[:, None]
    for _ in range(100):
        away = gap - x[:, None]
        away[away == 0] = EPS * EPS
        part = z2 / away
        psi, phi = np.where(lower, part, 0).sum(1), np.where(lower, 0, part).sum(1)
        f = 1 + psi + phi
        slope = part / away
        dpsi, dphi = np.where(lower, slope, 0).sum(1), np.where(lower, 0, slope).sum(1)
        done = (np.abs(f) <= 4 * EPS * n * (1 + np.abs(psi) + np.abs(phi))) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
        if done.all():
            break
        low, high = np.where(f < 0, x, low), np.where(f >= 0, x, high)
        d1, d2 = near - x, far - x
        c = f - d1 * dpsi - d2 * dphi
        a = (d1 + d2) * f - d1 * d2 * (dpsi + dphi)
        b = d1 * d2 * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            move = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = x + move
        new = np.where(np.isfinite(new) & (new > low) & (new < high), new, low + (high - low) / 2)
        x = np.where(done, x, new)
    return origin, x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues (rising) and their eigenvectors (columns) after v v' is added."""
    size = float(np.linalg.norm(v))
    if size == 0:
        return values, vectors
    z = vectors.T @ v
    rest = v - vectors @ z
    again = vectors.T @ rest  # once more, so that what is left is orthogonal
    z, rest = z + again, rest - vectors @ again
    out = float(np.linalg.norm(rest))
    if out > 64 * EPS * size and vectors.shape[1] < len(v):
        values, z = np.concatenate([[0.0], values]), np.concatenate([[out], z])
        vectors = np.column_stack([rest / out, vectors])
    top = max(float(values[-1]) if len(values) else 0.0, size * size)
    small = 8 * EPS * top
    # Deflation. Entries that don't count keep their pairs; of two near eigenvalues one entry is turned to zero.
    live = list(np.flatnonzero(np.abs(z) * size > small))
    if (np.diff(values[live]) <= small).any():
        vectors, z = vectors.copy(), z.copy()
        kept = []
        for k in live:
            if kept and values[k] - values[kept[-1]] <= small:
                j = kept[-1]
                r = math.hypot(z[j], z[k])
                c, s = z[k] / r, z[j] / r
                vectors[:, j], vectors[:, k] = c * vectors[:, j] - s * vectors[:, k], s * vectors[:, j] + c * vectors[:, k]
                z[j], z[k] = 0.0, r
                kept[-1] = k
            else:
                kept.append(k)
        live = kept
    if not live:
        return values, vectors
    d, zl = values[live], z[live]
    origin, x = secular_roots(d, zl * zl)
    gap = d - d[origin][:, None]
    away = x[:, None] - gap  # root less pole, without cancellation
    # Entries for which these roots are exact: eigenvectors are orthogonal however near the roots are.
    pole = d[:, None] - d
    np.fill_diagonal(pole, 1.0)
    exact = np.sqrt(np.abs(np.prod(away / pole, 0)))
    turn = np.copysign(exact, zl) / away
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    new = d[origin] + x
    vectors = vectors.copy()
    vectors[:, live] = vectors[:, live] @ turn.T
    values = values.copy()
    values[live] = new
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Number, mean and scatter matrix (as its spectrum) of vectors taken up so far."""

    def __init__(self, size: int) -> None:
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(size), np.zeros(0), np.zeros((size, 0))

    def add(self, x: np.ndarray) -> None:
        off = x - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, off * math.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.mean = self.mean + off / self.n

    def add_block(self, rows: np.ndarray) -> None:
        """Many vectors at once: as many centred updates as there are dimensions, with the same scatter, and one for the means."""
        if len(rows) <= rows.shape[1]:
            for x in rows:
                self.add(x)
            return
        mean = rows.mean(0)
        self._take(len(rows), mean, np.linalg.qr(rows - mean, mode="r"))

    def combine(self, other: Spectrum) -> None:
        self._take(other.n, other.mean, (other.vectors * np.sqrt(other.values)).T)

    def _take(self, n: int, mean: np.ndarray, updates: np.ndarray) -> None:
        for v in updates:
            self.values, self.vectors = rank_one(self.values, self.vectors, v)
        both, off = self.n + n, mean - self.mean
        if self.n and n:
            self.values, self.vectors = rank_one(self.values, self.vectors, off * math.sqrt(self.n * n / both))
        self.mean, self.n = self.mean + off * (n / max(both, 1)), both

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "mean": self.mean.tolist(), "vals": self.values.tolist(), "vecs": self.vectors.ravel().tolist()}

    @classmethod
    def of(cls, row) -> Spectrum:
        out = cls(len(row.mean))
        out.n, out.mean, out.values = int(row.n), np.array(row.mean, float), np.array(row.vals, float)
        out.vectors = np.array(row.vecs, float).reshape(len(out.mean), -1) if len(out.values) else out.vectors
        return out


SPECTRUM = "part long, n long, mean array<double>, vals array<double>, vecs array<double>"


def integers(vector: Column) -> Column:
    """floor(SCALE * entry) of each entry; null for a null vector and one with null or non-finite entries."""
    entry = lambda c: F.floor(c.cast("double") * SCALE).cast("long")
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(fine, F.transform(vector, entry))


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long lists as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def spectra(distinct: DataFrame, n: int) -> Spectrum:
    """The spectrum of all vectors x: of parts, then of SPECTRA_PER_TASK at a time until one is left."""
    parts = -(-n // ROWS_PER_PART)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, held = None, None, []
        for batch in batches:
            rows = matrix(batch.column(0)).astype(np.float64)
            if own is None and len(rows):
                own, part = Spectrum(rows.shape[1]), zlib.crc32(rows[0].tobytes())
            held.append(rows)
            if sum(map(len, held)) >= BLOCK_ROWS:
                own.add_block(np.concatenate(held))
                held = []
        if own is not None:
            own.add_block(np.concatenate([*held, np.zeros((0, len(own.mean)))]))
            yield pa.RecordBatch.from_pylist([own.row(part)])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        own = None
        for row in rows.itertuples():
            if own is None:
                own = Spectrum.of(row)
            else:
                own.combine(Spectrum.of(row))
        return pd.DataFrame([own.row(int(rows.part.iloc[0]))])

    now = materialise(map_arrow(distinct.select("x").repartition(parts, F.xxhash64("x")), take, SPECTRUM), "spectra")
    left = parts
    while left > 1:
        left = -(-left // SPECTRA_PER_TASK)
        now = materialise(now.groupBy(F.pmod(F.xxhash64("part"), F.lit(left)).alias("_group")).applyInPandas(merge, SPECTRUM), "spectra")
    return Spectrum.of(now.first())


def summed(vectors: DataFrame, centre: list[float], columns: list[list[float]]) -> np.ndarray:
    """The sum over all x of p p', where p is x less the centre on the columns; as many numbers as there are columns squared."""
    mean, basis = np.array(centre), np.array(columns).T

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((basis.shape[1], basis.shape[1]))
        for batch in batches:
            p = (matrix(batch.column(0)) - mean) @ basis
            total += p.T @ p
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    rows = map_arrow(vectors.select("x"), project, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((basis.shape[1], basis.shape[1]))
    for r in rows:
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


OUTPUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """embeddings (vec_id, embedding; further columns are ignored) -> a row for each row and component.

    Rows whose vector is null, empty, or has null or non-finite entries go, and those of another length than most (of equally
    frequent lengths the longest stays). Entries become x = floor(256 c). The fit list holds each distinct x once, so copies
    don't count. Gives vec_id, component (from 1, by falling eigenvalue; as many as there are dimensions, if fewer), n (the
    fit list's rows), deviation (sum over dimensions of (n x - S)^2, S the fit list's sums; null beyond a long), whitened
    (x less the mean on the eigenvector, over the eigenvalue's root), explained (the eigenvalue's share of the trace) and
    identity_error (the largest entry of whitened's covariance over the fit list less the identity, measured by a pass over
    it). Directions without spread have whitened 0, explained 0 and no part in identity_error. Repeated rows and ids, and null
    ids, give rows each. No row left: no rows.
    """
    spark = embeddings.sparkSession
    x = integers(F.col("embedding"))
    known = embeddings.select("vec_id", x.alias("x")).where("x IS NOT NULL AND size(x) > 0")
    usual = known.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, {OUTPUT}"
    if usual is None:
        return spark.createDataFrame([], schema)
    size = int(usual["d"])
    known = known.where(F.size("x") == size)
    fit = materialise(known.select("x").distinct(), "fit-list", 4096)
    entries = fit.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
    n, sums = int(entries[0]["n"]), [0] * size
    for r in entries:
        sums[r["k"]] = int(r["s"])
    mean = [s / n for s in sums]

    found = spectra(fit, n)
    basis = np.linalg.qr(np.column_stack([found.vectors[:, ::-1], np.eye(size)]))[0]  # the eigenvectors, and what they don't span
    ritz, turned = np.linalg.eigh(summed(fit, mean, basis.T.tolist()) / n)
    values, vectors = ritz[::-1], (basis @ turned)[:, ::-1]
    k = min(components, size)
    trace = float(values.sum())
    spread = [bool(v > FLAT * max(values[0], 0.0) and v > 0) for v in values[:k]]
    rule = vectors[:, :k] / np.where(spread, np.sqrt(np.maximum(values[:k], 1e-300)), 1.0) * np.array(spread)
    shares = [float(v) / trace if ok else 0.0 for v, ok in zip(values[:k], spread, strict=True)]
    own = [c for c in range(k) if spread[c]]
    error = float(np.abs(summed(fit, mean, rule[:, own].T.tolist()) / n - np.eye(len(own))).max()) if own else 0.0
    centre, total = np.array(mean), np.array(sums, object)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = len(batch)
            rows = matrix(batch.column(1))
            white = (rows - centre) @ rule
            most = max(int(np.abs(rows).max(initial=0)) * n, max(abs(s) for s in sums))
            if size * (2 * most) ** 2 < 1 << 62:
                away = [int(v) for v in ((rows * n - np.array(sums, np.int64)) ** 2).sum(1)]
            else:
                away = [v if v < 1 << 63 else None for v in ((rows.astype(object) * n - total) ** 2).sum(1)]
            ids = pa.concat_arrays([batch.column(0)]).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array([v for v in away for _ in range(k)], pa.int64()), pa.array(white.ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", *[c.split()[0] for c in OUTPUT.split(", ")]],
            )

    return map_arrow(known, kernel, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
