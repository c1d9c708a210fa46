"""Whitening of embeddings by a tall-skinny QR: no covariance matrix is formed.

Entries become whole numbers x = floor(256 c), so the sums by dimension, and each row's n x - sum, are exact. The centred rows of each
partition go block by block into one upper triangle R; triangles are merged FAN at a time until one is left, whose singular
values and right vectors are those of all centred rows. Each distinct row is fitted once, however many rows share it: the distinct rows are combined
before they are shuffled, so a group of copies is one row per task. A task holds a block of rows and FAN triangles of at most dimensions x dimensions; the driver one triangle.

Defined results: vectors that are null or hold null or non-finite entries are dropped, and so are those whose length isn't the commonest one (of equally
common ones the longest), which no common space holds. Entries beyond the range of a long saturate. Repeated rows, and rows without vec_id, are reported one
by one. A component whose singular value is below TINY of the largest has no variance to divide by and no rows: equal vectors only, or an empty table, give an empty result.
A deviation beyond the range of a long is null. Equal eigenvalues leave their components' order open. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, store

SCALE = 256
#: Triangles that one task merges.
FAN = 8
#: Rows that go into a triangle at once.
BLOCK_ROWS = 2048
#: A component with a smaller share of the largest singular value counts as being without variance.
TINY = 1e-11
_LONG = 2**63 - 1


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector has finite entries only and the commonest length, and a column x: entries times SCALE, rounded down."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))  # NaN is beyond infinity
    good = rows.where(F.coalesce(finite, F.lit(False)))
    length = good.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return good.where(F.size(vector) == (length["d"] if length else 0)).withColumn("x", F.transform(v, lambda c: F.floor(c * SCALE)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for rows in batches:
        for at in range(0, rows.num_rows, BLOCK_ROWS):
            part = rows.slice(at, BLOCK_ROWS)
            yield part, part["x"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the upper and lower 32 bits of each dimension, which no partition overflows."""
    n, high, low = 0, 0, 0
    for _, x in _blocks(batches):
        n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), *(pa.ListArray.from_arrays([0, len(s)], pa.array(s, pa.int64())) for s in (high, low))], names=["n", "high", "low"])


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of rows x and their sums by dimension, as whole numbers of any size."""
    parts = fit.select("x").mapInArrow(_halves, "n long, high array<long>, low array<long>")
    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    flat = parts.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "s")).select("n", "at", "s.high", "s.low")
    got = flat.groupBy("at").agg(F.sum("n").alias("n"), big("high").alias("high"), big("low").alias("low")).orderBy("at").collect()  # a row per dimension
    return (got[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in got]) if got else (0, [])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - sums, exactly: as longs where they fit, else as Python's whole numbers."""
    most = n * (int(np.abs(x.astype(np.float64)).max(initial=0)) + 1) + max(map(abs, sums), default=0)
    kind = np.int64 if most < 2**62 else object
    return n * x.astype(kind) - np.array(sums, dtype=kind)


def squares(z: np.ndarray) -> list[int | None]:
    """Sums of squares by row, exactly; None beyond the range of a long."""
    about = (z.astype(np.float64) ** 2).sum(axis=1)
    out: list[int | None] = [None] * len(z)
    small = np.flatnonzero(about < 2.0**62)
    for i, s in zip(small.tolist(), (z[small].astype(np.int64) ** 2).sum(axis=1).tolist(), strict=True):
        out[i] = s
    for i in np.flatnonzero((about >= 2.0**62) & (about < 1.01 * 2.0**63)).tolist():
        s = sum(int(v) ** 2 for v in z[i])
        out[i] = s if s <= _LONG else None
    return out


def _triangle(r: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays([0, r.size], pa.array(r.ravel(), pa.float64()))


def _leaves(n: int, sums: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = None
        for _, x in _blocks(batches):
            centred = deviations(x, n, sums).astype(np.float64) / n
            r = np.linalg.qr(centred if r is None else np.vstack([r, centred]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), _triangle(r)], names=["node", "r"])

    return run


def _merge(d: int):
    def run(rows: pa.Table) -> pa.Table:
        stacked = np.concatenate([x.values.to_numpy() for x in rows["r"]]).reshape(-1, d)
        return pa.table({"node": rows["node"][:1], "r": _triangle(np.linalg.qr(stacked, mode="r"))}, schema=pa.schema([("node", pa.int32()), ("r", pa.list_(pa.float64()))]))

    return run


def tsqr(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The triangle R of all centred rows x: R'R is n times their covariance. Partitions' triangles are merged as a tree."""
    level = store(fit.select("x").mapInArrow(_leaves(n, sums), "node int, r array<double>"), "whitening-leaves")
    leaves, width = level, level.agg(F.max("node")).first()[0] + 1
    while width > 1:
        level = level.withColumn("node", F.floor(F.col("node") / FAN).cast("int")).groupBy("node").applyInArrow(_merge(len(sums)), "node int, r array<double>")
        width = -(-width // FAN)
    r = np.array(level.first()["r"]).reshape(-1, len(sums))
    discard(leaves)
    return r


def _projected(n: int, sums: list[int], axes: np.ndarray, with_id: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in _blocks(batches):
            z = deviations(x, n, sums)
            w = (z.astype(np.float64) / n) @ axes
            white = pa.FixedSizeListArray.from_arrays(pa.array(w.ravel(), pa.float64()), w.shape[1]).cast(pa.list_(pa.float64()))
            columns = {"vec_id": rows["vec_id"], "deviation": pa.array(squares(z), pa.int64())} if with_id else {}
            yield pa.RecordBatch.from_pydict(columns | {"whitened": white})

    return run


def whiten(rows: DataFrame, components: int = 4, vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each remaining row and leading component."""
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    used = whole_vectors(rows, vector).select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    fit = store(used.select("x").distinct(), "whitening-fit")
    n, sums = exact_sums(fit)
    if not sums:
        return empty
    _, s, right = np.linalg.svd(tsqr(fit, n, sums), full_matrices=False)
    e = s * s / n
    k = min(components, int((s > TINY * s[0]).sum()))
    if not k:
        return empty
    axes = right[:k].T / np.sqrt(e[:k])
    white = fit.mapInArrow(_projected(n, sums, axes, False), "whitened array<double>")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = white.agg(*(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"{i}_{j}") for i, j in pairs)).first()
    error = max(abs(found[f"{i}_{j}"] - (i == j)) for i, j in pairs)
    discard(fit)
    share = F.array(*(F.lit(float(v)) for v in e[:k] / e.sum()))
    out = used.mapInArrow(_projected(n, sums, axes, True), "vec_id long, deviation long, whitened array<double>").select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"))
