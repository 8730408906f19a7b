"""Whitening of embeddings from an exact covariance.

Entries are fixed-point numbers. Sums of squares of every centred dimension and of every sum of two dimensions are added up as
whole numbers; by polarisation, cov(a, b) = (var(a + b) - var(a) - var(b)) / 2, their differences are all covariances,
exact until the one division at the end. The matrix has the square of the dimensions as its size, whatever the rows.
"""

from __future__ import annotations

import re
import uuid
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.session import shared_dir

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 50)  # scaled entries beyond this count as this: sums of squares stay whole numbers of 38 digits
LEAST_VALUE = 1e-12  # eigenvalues below this share of the trace are those of a dimension that isn't there


def fixed_point(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry c; null where the vector is null or an entry is null or not finite."""
    sound = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    scaled = F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-LARGEST)), F.lit(LARGEST))) + SHIFT)
    return F.when(sound, scaled)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), width)


def _blocks(batches, width: int):
    for batch in batches:
        for at in range(0, len(batch), 512):
            yield batch.slice(at, 512), _matrix(batch.slice(at, 512).column("x"), width)


def _square_sums(fit: DataFrame, width: int, centre: np.ndarray) -> dict[tuple[int, int], int]:
    """{(i, j): sum of (y_i + y_j)^2, for i = j of y_i^2} with y = x - centre, over all rows; one row a pair comes to the driver."""
    def run(batches):
        total = {}
        for _, x in _blocks(batches, width):
            y = x - centre
            if len(y) and max(-int(y.min()), int(y.max())) >= 1 << 25:
                y = y.astype(object)  # too large for squares of 512 rows in 64 bits
            for i in range(width):
                pair = y[:, i:i + 1] + y[:, i:]
                pair[:, 0] = y[:, i]
                for j, s in enumerate((pair * pair).sum(axis=0), i):
                    total[i, j] = total.get((i, j), 0) + int(s)
        if total:
            i, j = zip(*total)
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "part": [str(s) for s in total.values()]})

    parts = fit.mapInArrow(run, "i int, j int, part string")
    return {(r["i"], r["j"]): int(r["total"]) for r in parts.groupBy("i", "j").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()}


def covariance(squares: dict[tuple[int, int], int], n: int, rest: list[int]) -> np.ndarray:
    """V from sums of squares around a whole number; `rest` are the sums of y, which move the centre to the mean exactly.

    sum (n y - T)^2 = n^2 sum y^2 - n T^2, with T = sum y, is n^3 times the variance.
    """
    width = len(rest)
    around = {(i, j): n * s - (rest[i] + (rest[j] if i != j else 0)) ** 2 for (i, j), s in squares.items()}  # n^2 times the variance
    v = np.empty((width, width))
    for i in range(width):
        for j in range(i, width):
            both = around[i, i] if i == j else Fraction(around[i, j] - around[i, i] - around[j, j], 2)
            v[i, j] = v[j, i] = float(Fraction(both) / (n * n))
    return v


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) by falling eigenvalue, `most` at most, none without variance; the largest entry of a vector is positive."""
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    real = values > max(LEAST_VALUE * np.trace(v), 0)
    values, vectors = values[real], vectors[:, real]
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[top, np.arange(len(values))] < 0, -1.0, 1.0)


def whitened(embeddings: DataFrame, most: int = 16, folder: str | None = None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every sound row (vec_id, embedding) and component.

    Rows whose vector is null or holds null, NaN or infinite entries are dropped; so are vectors of another length than
    most have (of equally frequent lengths the largest), as they lack entries or have no place for them. The model is fitted
    on each distinct fixed-point vector once, so repeated rows count once there and all have their rows in the result; a
    null or repeated vec_id is carried along. There are as many components as the covariance has positive eigenvalues, `most` at
    most: one distinct vector, vectors without entries or an empty table give no rows. A deviation beyond a long is null. Of
    equal eigenvalues any order and basis is right. Further columns are not read. The fit list is written under `folder`, by
    default the cluster's checkpoint folder.
    """
    spark = embeddings.sparkSession
    root = folder or re.sub(r"/?$", f"/whitening-{uuid.uuid4().hex}", shared_dir(spark))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sound = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), fixed_point(embeddings["embedding"]).alias("x")).filter("size(x) > 0")
    lengths = sound.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    width = lengths[0]["width"]
    sound = sound.filter(F.size("x") == width)
    sound.select("x").distinct().write.parquet(f"{root}/fit")
    fit = spark.read.parquet(f"{root}/fit")

    totals = fit.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("total")).collect()
    n, sums = totals[0]["n"], [int(r["total"]) for r in sorted(totals, key=lambda r: r["i"])]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    v = covariance(_square_sums(fit, width, centre), n, [s - n * int(c) for s, c in zip(sums, centre)])
    values, vectors = components(v, most)
    if not len(values):
        return spark.createDataFrame([], schema)
    trace, rest, to_white = float(np.trace(v)), [s - n * int(c) for s, c in zip(sums, centre)], vectors / np.sqrt(values)

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - centre) - np.array([float(Fraction(t, n)) for t in rest])) @ to_white

    def moments(batches):
        k = len(values)
        total, square = np.zeros(k), np.zeros((k, k))
        for _, x in _blocks(batches, width):
            w = project(x)
            total += w.sum(axis=0)
            square += w.T @ w
        flat = np.concatenate((total, square.ravel()))
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(flat)), pa.int32()), "part": flat})

    k = len(values)
    got = np.zeros(k + k * k)
    for r in fit.mapInArrow(moments, "at int, part double").groupBy("at").agg(F.sum("part").alias("total")).collect():
        got[r["at"]] = r["total"]
    mean = got[:k] / n
    error = float(np.abs(got[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    def run(batches):
        for batch, x in _blocks(batches, width):
            far, t = x - centre, np.array(rest, object)
            reach = max(-int(far.min()), int(far.max()), 1) * n + max(map(abs, rest))
            if width * reach * reach < 1 << 63:
                deviation = ((n * far - t.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [d if d < 1 << 63 else None for d in ((n * far.astype(object) - t) ** 2).sum(axis=1)]
            rows = np.repeat(np.arange(len(batch)), k)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch))), pa.array(np.full(len(rows), n)),
                pa.array(deviation, pa.int64()).take(pa.array(rows)), pa.array(project(x).ravel()), pa.array(np.tile(values / trace, len(batch))),
                pa.array(np.full(len(rows), error))], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return sound.mapInArrow(run, schema)
