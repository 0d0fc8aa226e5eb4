"""Embedding whitening (operator 13): incremental eigendecomposition, then a distributed Rayleigh-Ritz refinement.

1. Each finite vector becomes integers x = floor(``scale`` * c) + ``shift``. The fit list is each distinct x once, written as a table.
2. Its size n and sums S by dimension are exact, so a row is centred exactly: (n * x - S) / n.
3. A task starts from an empty spectrum and adds its centred rows as rank-one updates: secular equation, deflation of
   directions that an update does not touch and of equal eigenvalues (``spectrum.add_outer``).
4. Spectra are combined in groups of ``FAN``, level by level, each by successive rank-one updates with the other's weighted
   eigenvectors. A group holds ``FAN`` spectra of dims^2 numbers; nothing grows with the rows.
5. Rayleigh-Ritz: tasks project their centred rows on the basis and sum products; the small matrix is diagonalised on the
   driver and turns the basis. A further pass measures the whitened covariance over the fit list. This repeats while that
   measurement gets better by half and is over ``CLOSE``.

Rows of another length than most (at equal numbers: the longer) are dropped like those with nulls or non-finite entries. Repeated rows
count once in the fit list and are all returned, also rows without an id. Directions without variance (a 10^-12 part of the trace)
give no component. No rows, or only equal ones, give no rows. Integers are held within +-2^62, a deviation at 2^63 - 1 at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm.common import written
from veil.llm.spectrum import add_outer, add_spectrum, empty
from veil.llm.vectors import finite, list_array

FAN = 8
CLOSE = 1e-11
HOLD, MOST = 1 << 62, (1 << 63) - 1
SPECTRUM = "node bigint, eigenvalues array<double>, vectors array<double>"


def _gaps(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact."""
    wide = n * (int(np.abs(x).max()) if x.size else 0) + max(map(abs, sums)) > MOST
    kind = object if wide else np.int64
    return x.astype(kind) * n - np.array(sums, dtype=kind)[None, :]


def _rows(batches: Iterator[pa.RecordBatch], column: int, d: int, n: int, sums: list[int], step: int = 8192) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with n * x - S and the centred rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            gaps = _gaps(part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d), n, sums)
            yield part, gaps, (gaps / n).astype(np.float64)


def _spectra(fit: DataFrame, d: int, n: int, sums: list[int]) -> DataFrame:
    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, vectors = empty(d)
        for _, _, centred in _rows(batches, 0, d, n, sums):
            for v in centred:
                values, vectors = add_outer(values, vectors, v)
        yield pa.RecordBatch.from_pydict({"node": pa.array([TaskContext.get().partitionId()], pa.int64()), "eigenvalues": list_array(values[None, :]), "vectors": list_array(vectors.reshape(1, -1))})

    return fit.mapInArrow(update, SPECTRUM)


def _combined(spectra: DataFrame, d: int) -> DataFrame:
    def combine(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = [(np.asarray(r.eigenvalues, dtype=np.float64), np.asarray(r.vectors, dtype=np.float64).reshape(d, d)) for r in rows.sort_values("node").itertuples()]
        total = parts[0]
        for part in parts[1:]:
            total = add_spectrum(total, part)
        return pd.DataFrame({"node": [key[0]], "eigenvalues": [total[0]], "vectors": [total[1].ravel()]})

    return spectra.groupBy(F.floor(F.col("node") / FAN).alias("above")).applyInPandas(combine, SPECTRUM)


def _projected_covariance(fit: DataFrame, basis: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    d = len(sums)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for _, _, centred in _rows(batches, 0, d, n, sums):
            on = centred @ basis
            total += on.T @ on
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(d), pa.int32()), "row": list_array(total)})

    parts = fit.mapInArrow(project, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "s")).groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = np.zeros((d, d))
    for r in parts.collect():  # d * d numbers
        out[r["i"], r["j"]] = r["s"]
    return (out + out.T) / (2 * n)


@dataclass
class Whitening:
    """``basis``: unit eigenvectors as columns, by falling ``eigenvalues``, as far as they have variance; ``trace`` of the covariance."""

    n: int
    sums: list[int]
    basis: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def _integers(vectors: DataFrame, scale: int, shift: int, id_col: str, vector_col: str) -> DataFrame:
    hold = F.lit(float(HOLD))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where(finite(F.col("vector")) & (F.size("vector") > 0))
    whole = F.transform("vector", lambda c: F.greatest(F.least(F.floor(c.cast("double") * F.lit(float(scale))).cast("double"), hold), -hold).cast("long") + F.lit(shift).cast("long"))
    return rows.select("vec_id", whole.alias("x"))


def fit_whitening(x: DataFrame, keep: int = 16) -> Whitening | None:
    """``x``: a column x of equally long integer vectors. None without two different ones."""
    fit = written(x.select("x").distinct(), "whitening-fit")
    added = fit.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("d").collect()
    if not added or added[0]["n"] < 2:
        return None
    n, sums, d = added[0]["n"], [int(r["s"]) for r in added], len(added)
    spectra, nodes = written(_spectra(fit, d, n, sums), "spectra"), fit.rdd.getNumPartitions()
    while nodes > 1:
        spectra, nodes = written(_combined(spectra, d), "spectra"), -(-nodes // FAN)
    basis = np.asarray(spectra.first()["vectors"], dtype=np.float64).reshape(d, d)
    best = None
    while True:
        basis = np.linalg.qr(basis[:, ::-1] if best is None else basis)[0]
        small = _projected_covariance(fit, basis, n, sums)
        if best is not None:
            e = np.diag(small)
            some = int((e[:keep] > 1e-12 * np.trace(small)).sum())
            white = small[:some, :some] / np.sqrt(np.outer(e[:some], e[:some]))
            # The diagonal is measured against the eigenvalues in use, so it tells, too.
            scaled = white * np.sqrt(np.outer(e[:some], e[:some])) / np.sqrt(np.outer(values[:some], values[:some]))
            error = float(np.abs(scaled - np.eye(some)).max(initial=0.0))
            found = Whitening(n, sums, basis[:, :some], values[:some], float(np.trace(small)), error)
            if error <= CLOSE or (best is not False and error > best.identity_error / 2):
                return found if best is False or error <= best.identity_error else best
            best = found
        else:
            best = False
        values, turn = np.linalg.eigh(small)
        values, basis = values[::-1], basis @ turn[:, ::-1]


def whiten(vectors: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: each row on each of the first ``components``."""
    x = _integers(vectors, scale, shift, id_col, vector_col)
    most = x.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    model = None
    if most is not None:
        x = x.where(F.size("x") == most["d"])
        model = fit_whitening(x, components)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums, d = model.n, model.sums, len(model.sums)
    onto = model.basis / np.sqrt(model.eigenvalues)[None, :]
    explained, k = model.eigenvalues / model.trace, len(model.eigenvalues)
    error = model.identity_error

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, gaps, centred in _rows(batches, 1, d, n, sums):
            largest = int(abs(gaps).max()) if gaps.size else 0
            wide = gaps if largest * largest * d <= MOST else gaps.astype(object)
            deviation = np.array([min(int(v), MOST) for v in (wide * wide).sum(axis=1)], dtype=np.int64)
            size = part.num_rows
            yield pa.RecordBatch.from_pydict({
                "vec_id": part.column(0).take(pa.array(np.repeat(np.arange(size), k))), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                "n": pa.array(np.full(size * k, n, dtype=np.int64)), "deviation": pa.array(np.repeat(deviation, k)), "whitened": pa.array((centred @ onto).ravel()),
                "explained": pa.array(np.tile(explained, size)), "identity_error": pa.array(np.full(size * k, error))})

    return x.mapInArrow(project, schema)
