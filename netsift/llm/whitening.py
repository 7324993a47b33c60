"""Whitening of embeddings from exact bit-sliced cross-products.

Entries become integers x = floor(64 c) + 1,000,000. Each dimension is shifted by its minimum, its bit planes
are packed across rows into 64-bit words, and the cross-product of two dimensions is the sum of
2^(a+b) popcount(plane a AND plane b): integers, exact at any number of rows. Tasks return such sums for their
rows, Spark adds them up, and the driver sees one number per pair of dimensions (never rows). There they are
centred as integers, n * sum(x y) - sum(x) sum(y), before one division gives the covariance for ``eigh``.

Sums of 2^s counts are kept in digits of 16 shifts each, so no digit of a table of fewer than 2^45 rows
leaves 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import docs_of
from netsift.session import materialize

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Rows whose planes are packed together, words of a row of planes times this: memory of a task.
PACKED_ROWS = 4096
DIGIT = 16
#: Components with less variance than this share of the first are no directions but rounding.
LEAST_SHARE = 1e-11
#: Entries beyond this either way would leave 64 bits as x; their rows are dropped like non-finite ones.
MOST = 2.0**55


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): x is floor(64 c) + 1,000,000 per entry, c as double. Rows are dropped whose vector is null
    or empty or holds an entry that is null, not finite, or beyond 2^55 either way."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = (F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(c.between(-MOST, MOST), F.lit(False)))
    x = F.transform("v", lambda c: (F.floor(c * SCALE) + OFFSET).cast("long"))
    return rows.where(F.col("v").isNotNull() & sound).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _planes(shifted: np.ndarray, bits: int) -> np.ndarray:
    """(dims, bits, words) of packed bit planes of a rows x dims matrix of unsigned integers."""
    rows, dims = shifted.shape
    padded = np.zeros((-(-rows // 64) * 64, dims), np.uint64)
    padded[:rows] = shifted
    out = np.empty((dims, bits, len(padded) // 64), np.uint64)
    for b in range(bits):
        plane = ((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        out[:, b, :] = np.packbits(np.ascontiguousarray(plane.T), axis=1).view(np.uint64)
    return out


def cross_products(x: np.ndarray, low: np.ndarray, bits: int, sums: np.ndarray) -> None:
    """Add the rows of ``x`` to ``sums`` (digits, dims + 1, dims + 1): sum over rows of u_i u_j, u being x - low
    and, as the last dimension, 1."""
    dims = x.shape[1]
    planes = _planes(np.column_stack([x - low, np.ones(len(x), np.int64)]).astype(np.uint64), bits)
    flat = planes.reshape((dims + 1) * bits, -1)
    for i in range(dims + 1):
        for a in range(bits):
            if not planes[i, a].any():
                continue
            counts = np.bitwise_count(planes[i, a] & flat[i * bits :]).sum(axis=1, dtype=np.int64).reshape(-1, bits)
            for b in range(bits):
                s = a + b
                sums[s // DIGIT, i, i:] += counts[:, b] << (s % DIGIT)


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict | None:
    """The whitening learned from ``rows`` (x): n distinct vectors, S their sums, directions (dims x k),
    eigenvalues, shares of variance and identity_error. Vectors of another length than the commonest (the
    shorter of equals) are not fitted. None if there is no vector. Repeated vectors count once."""
    lengths = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if lengths is None:
        return None
    dims = lengths["dims"]
    # equal vectors meet on their whole value, combined where they are first
    distinct = materialize(rows.where(F.size("x") == dims).select("x").distinct(), "whitening-fit")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        n = 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), dims)
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dims)), pa.array(low), pa.array(high), pa.array(np.full(dims, n))], names=["d", "low", "high", "n"]
            )

    edge = distinct.mapInArrow(bounds, "d bigint, low bigint, high bigint, n bigint").groupBy("d")
    edge = edge.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("d").collect()
    low = np.array([r["low"] for r in edge], np.int64)
    bits = max(1, max(r["high"] - r["low"] for r in edge).bit_length())
    n = edge[0]["n"]
    digits = (2 * bits - 2) // DIGIT + 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((digits, dims + 1, dims + 1), np.int64)
        seen = 0
        for batch in batches:
            x = _matrix(batch.column(0), dims)
            for at in range(0, len(x), PACKED_ROWS):
                cross_products(x[at : at + PACKED_ROWS], low, bits, sums)
            seen += len(x)
        if seen:
            digit, i, j = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (digit, i, j, sums[digit, i, j])], names=["digit", "i", "j", "total"]
            )

    added = distinct.mapInArrow(products, "digit bigint, i bigint, j bigint, total bigint").groupBy("digit", "i", "j")
    crossed = np.zeros((dims + 1, dims + 1), object)
    for r in added.agg(F.sum("total").alias("total")).toLocalIterator():
        crossed[r["i"], r["j"]] += r["total"] << (DIGIT * r["digit"])
    ones = crossed[:-1, -1]
    upper = np.triu(crossed[:-1, :-1])
    whole = upper + np.triu(upper, 1).T
    centred = n * whole - np.outer(ones, ones)
    covariance = np.array([[c / (n * n) for c in line] for line in centred], float)
    value, vector = np.linalg.eigh(covariance)
    value, vector = value[::-1], vector[:, ::-1]
    k = int((value[:components] > max(value[0], 0) * LEAST_SHARE).sum()) if value[0] > 0 else 0
    sums = [int(s) + n * int(m) for s, m in zip(ones, low, strict=True)]
    model = {
        "n": n, "dims": dims, "sums": sums, "values": value[:k], "directions": vector[:, :k],
        "explained": value[:k] / np.trace(covariance) if k else value[:0],
    }
    return {**model, "identity_error": _identity_error(distinct, model) if k else 0.0}


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n as doubles: the whole part of S / n is taken off as integers, so nothing is cancelled."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole) - rest


def _whitened(x: np.ndarray, model: dict) -> np.ndarray:
    return _centred(x, model["n"], model["sums"]) @ model["directions"] / np.sqrt(model["values"])


def _identity_error(distinct: DataFrame, model: dict) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    dims, k = model["dims"], len(model["values"])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square, seen = np.zeros(k), np.zeros((k, k)), 0
        for batch in batches:
            z = _whitened(_matrix(batch.column(0), dims), model)
            total += z.sum(0)
            square += z.T @ z
            seen += len(z)
        if seen:
            i, j = np.indices((k + 1, k)).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.vstack([square, total]).ravel())], names=["i", "j", "v"])

    got = np.zeros((k + 1, k))
    for r in distinct.mapInArrow(moments, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        got[r["i"], r["j"]] = r["v"] / model["n"]
    # whitened vectors are centred already, what is left of their mean is taken off here
    return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """sum over dimensions of (n x - S)^2 per row, as integers of any size: n x - S is n times a small whole
    part plus a rest below n, so three sums of 64 bits and a few products of Python integers do."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    y = x - whole
    if not len(y):
        return []
    fits = int(np.abs(y).max()).bit_length() * 2 + int(y.shape[1]).bit_length() <= 62
    y = y if fits else y.astype(object)
    squares = (y * y).sum(1).tolist()
    split = 1 << 20  # rest in digits, so that the products below stay inside 64 bits
    parts, left = [], rest
    while any(left):
        parts.append([r % split for r in left])
        left = [r // split for r in left]
    mixed = [0] * len(y)
    for place, digits in enumerate(parts):
        wide = fits and int(np.abs(y).max()).bit_length() + 20 + int(y.shape[1]).bit_length() <= 62
        line = ((y if wide else y.astype(object)) @ np.array(digits, np.int64 if wide else object)).tolist()
        mixed = [m + (v << (20 * place)) for m, v in zip(mixed, line, strict=True)]
    last = sum(r * r for r in rest)
    return [n * n * s - 2 * n * m + last for s, m in zip(squares, mixed, strict=True)]


def whitened_vectors(vectors: DataFrame, components: int = COMPONENTS, **names) -> DataFrame:
    """Per usable row and component: vec_id, component (from 1), n, deviation decimal(38, 0), whitened, explained,
    identity_error. Rows that :func:`integer_vectors` drops, and those of another length than the fitted one,
    have no rows; repeated rows have their own; null ids stay. Directions without variance (a constant table, a
    single vector) are no components. A deviation of over 38 digits is null. An empty table gives an empty result."""
    rows = integer_vectors(vectors, **names)
    schema = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    model = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims, k = model["dims"], len(model["values"])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            z = _whitened(x, model)
            m = len(x)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            exact = [d if d < 10**38 else None for d in _deviations(x, model["n"], model["sums"])]
            far = pa.array(exact, pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model["n"])),
                    far.take(pa.array(np.repeat(np.arange(m), k))), pa.array(z.ravel()),
                    pa.array(np.tile(model["explained"], m)), pa.array(np.full(m * k, model["identity_error"])),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    fitted = docs_of(rows, "vec_id", "x").where(F.size("x") == dims).select(F.col("vec_id").cast("long"), "x")
    return fitted.mapInArrow(project, schema)
