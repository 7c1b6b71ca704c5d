"""Whitening of embeddings by the covariance of their distinct integer vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm.common import finished, stored, table

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Beyond this, floor(64 * c) is no exact integer of a double.
LARGEST = float(1 << 53)
#: Components whose share of the largest eigenvalue is below this have no variance but rounding.
LEAST_SHARE = 1e-12
LONG_MAX = (1 << 63) - 1
#: Rows of one block of numpy work hold about so many numbers.
BLOCK_NUMBERS = 1 << 20
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


@dataclass(frozen=True)
class Model:
    """``n`` fit weights with sums ``sums`` of x, mean ``pivot + rest``, eigenvectors as columns, falling eigenvalues, trace of the covariance."""

    n: int
    sums: list[int]
    pivot: np.ndarray
    rest: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def pack(x: np.ndarray) -> list[bytes]:
    """Each row of integers as bytes of the least width that holds it; equal rows, and only these, give equal bytes."""
    if not x.shape[1]:
        return [b""] * len(x)
    low, high = x.min(1), x.max(1)
    out: list[bytes] = [b""] * len(x)
    open_ = np.ones(len(x), bool)
    for width in _WIDTHS:
        fits = open_ & (low >= np.iinfo(width).min) & (high <= np.iinfo(width).max)
        open_ &= ~fits
        for row, of in zip(np.flatnonzero(fits), x[fits].astype(width), strict=True):
            out[row] = of.tobytes()
    return out


def unpack(keys: list[bytes], dimensions: int) -> np.ndarray:
    out = np.empty((len(keys), dimensions), np.int64)
    sizes = np.array([len(k) for k in keys])
    for width in _WIDTHS:
        rows = np.flatnonzero(sizes == dimensions * np.dtype(width).itemsize)
        if len(rows):
            out[rows] = np.frombuffer(b"".join(keys[r] for r in rows), width).reshape(len(rows), dimensions)
    return out


def _usable(vector: str, dimensions: int) -> F.Column:
    """Whether the vector has ``dimensions`` entries, all of them finite numbers whose x is exact."""
    return (F.size(vector) == dimensions) & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < LARGEST, F.lit(False)))


def dimensions_of(rows: DataFrame, vector: str) -> int:
    """The most frequent number of entries among vectors of finite numbers; of equally frequent ones the largest, 0 where there are none."""
    usable = rows.filter(_usable(vector, F.size(vector)) & (F.size(vector) > 0))
    most = usable.groupBy(F.size(vector).alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return most["d"] if most else 0


def integer_vectors(rows: DataFrame, ident: str, vector: str, dimensions: int) -> DataFrame:
    """(ident, key) of each usable row; key holds its x, less ``OFFSET``, as bytes."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, BLOCK_NUMBERS // dimensions)
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
                keys = pack(np.floor(SCALE * values).astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary())], [ident, "key"])

    kind = rows.schema[ident].dataType.simpleString()
    return rows.filter(_usable(vector, dimensions)).select(ident, vector).mapInArrow(convert, f"`{ident}` {kind}, key binary")


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    step = max(1, BLOCK_NUMBERS // dimensions)
    for batch in batches:
        for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
            yield unpack(part.column("key").to_pylist(), dimensions), part.column("weight").to_numpy(), part


def _sums(distinct: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """Total weight, and the exact weighted sum of each dimension of x - OFFSET; one row a dimension comes to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, weight, _ in _blocks(batches, dimensions):
            if int(np.abs(x).max(initial=0)) * int(weight.sum()) > LONG_MAX:
                x = x.astype(object)
            total = [int(weight.sum()), *(weight[:, None] * x).sum(0).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dimensions), pa.int32()), pa.array(map(str, total), pa.string())], ["d", "s"])

    rows = distinct.mapInArrow(add, "d int, s string").groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {r["d"]: int(r["s"]) for r in rows}
    return by.get(-1, 0), [by.get(d, 0) for d in range(dimensions)]


def _second_moment(frame: DataFrame, centred, width: int) -> np.ndarray:
    """Sum over rows of weight times y y', y the rows that ``centred`` makes of a batch.

    A task multiplies block by block into one matrix; the matrices of all tasks
    are added up by Spark, and only the sum comes to the driver.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), False
        for y, weight in centred(batches):
            total += (y * weight[:, None]).T @ y
            seen = True
        for i in range(width if seen else 0):
            row = pa.array(total[i, i:])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(width - i, i, np.int32)), pa.array(np.arange(i, width, dtype=np.int32)), row], ["i", "j", "s"])

    rows = frame.mapInArrow(multiply, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros((width, width))
    i, j = rows.column("i").to_numpy(), rows.column("j").to_numpy()
    out[i, j] = out[j, i] = rows.column("s").to_numpy()
    return out


def fit(distinct: DataFrame, dimensions: int, components: int = COMPONENTS) -> Model | None:
    """The model of ``distinct`` (key, weight); None where there are no rows.

    The sums are exact. The covariance is that of x less its mean: the mean is
    taken off as an integer and a rest below one, so nothing cancels.
    """
    n, sums = _sums(distinct, dimensions)
    if not n:
        return None
    pivot = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([(s - n * int(p)) / n for s, p in zip(sums, pivot, strict=True)])

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for x, weight, _ in _blocks(batches, dimensions):
            yield (x - pivot) - rest, weight

    covariance = _second_moment(distinct, centred, dimensions) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(components, int((values > max(values[0], 0) * LEAST_SHARE).sum()))
    vectors = vectors[:, :kept] * np.where(np.take_along_axis(vectors[:, :kept], np.abs(vectors[:, :kept]).argmax(0)[None], 0) < 0, -1.0, 1.0)
    return Model(n, [s + n * OFFSET for s in sums], pivot, rest, np.ascontiguousarray(vectors), values[:kept].copy(), float(np.trace(covariance)))


def _deviation(x: np.ndarray, model: Model) -> list[int | None]:
    """Exact sums of (n * x - S)^2; None where one is beyond a long. ``x`` is less ``OFFSET``."""
    shifted = [s - model.n * OFFSET - model.n * int(p) for s, p in zip(model.sums, model.pivot, strict=True)]
    largest = model.n * int(np.abs(x - model.pivot).max(initial=0)) + max(map(abs, shifted), default=0)
    if x.shape[1] * largest * largest <= LONG_MAX:
        return ((model.n * (x - model.pivot) - np.array(shifted, np.int64)) ** 2).sum(1).tolist()
    exact = ((model.n * (x - model.pivot).astype(object) - np.array(shifted, object)) ** 2).sum(1)
    return [int(v) if v <= LONG_MAX else None for v in exact]


def whiten_distinct(distinct: DataFrame, model: Model, dimensions: int) -> DataFrame:
    """(key, copies, weight, deviation, whitened) of each row of ``distinct`` (key, copies, weight)."""
    sent = distinct.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        by = held.vectors / np.sqrt(held.values)
        for x, _, part in _blocks(batches, dimensions):
            whitened = ((x - held.pivot) - held.rest) @ by
            ends = pa.array(np.arange(0, whitened.size + 1, whitened.shape[1]) if whitened.shape[1] else np.zeros(len(x) + 1), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(whitened.reshape(-1)))
            columns = [part.column("key"), part.column("copies"), part.column("weight"), pa.array(_deviation(x, held), pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["key", "copies", "weight", "deviation", "whitened"])

    return distinct.mapInArrow(project, "key binary, copies long, weight long, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    width = len(model.values)
    if not width:
        return 0.0

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            z = batch.column("whitened").flatten().to_numpy().reshape(-1, width)
            # A column of ones gives the sums, to take off what rounding left of the mean.
            yield np.hstack([z, np.ones((len(z), 1))]), batch.column("weight").to_numpy()

    moment = _second_moment(whitened.select("whitened", "weight"), centred, width + 1) / model.n
    mean = moment[:width, width]
    return float(np.abs(moment[:width, :width] - np.outer(mean, mean) - np.eye(width)).max())


def whiten(rows: DataFrame, ident: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, weigh_copies: bool = False) -> DataFrame:
    """Stored (ident, n, copies, deviation, whitened, explained, identity_error) of each usable row.

    An entry c becomes x = floor(64 * c) + 1000000. Rows of the same x are
    grouped first, so copies are multiplied and projected once whatever their
    number; a distinct vector weighs one in the fit, or its number of copies
    with ``weigh_copies``. ``n`` is the sum of weights, ``whitened`` has up to
    ``components`` entries by falling variance, and ``explained`` their shares
    of the whole variance.

    The copies of a vector are counted before the shuffle. The rows meet their
    distinct vector again by a join that adaptive execution can split, so one
    vector may hold any share of the rows. Driver and tasks hold one square
    matrix of the dimensions, and no row.

    Edge cases: rows whose vector is null or empty, or holds a null, a number
    that isn't finite or one beyond 2^47 go, and so do those that have not the
    most frequent number of entries (of equally frequent ones the largest
    counts). Rows that repeat an id, or have none, are rows like any. Components
    without variance are left out: a table of one distinct vector gives empty
    arrays, an empty table no rows. A deviation beyond a long is null. Other
    columns are not read.
    """
    return finished(rows.sparkSession, lambda: _whitened(rows, ident, vector, components, weigh_copies))


def _whitened(rows: DataFrame, ident: str, vector: str, components: int, weigh_copies: bool) -> DataFrame:
    spark = rows.sparkSession
    kind = rows.schema[ident].dataType.simpleString()
    dimensions = dimensions_of(rows, vector)
    keyed = stored(integer_vectors(rows, ident, vector, dimensions)) if dimensions else None
    counted = keyed and keyed.groupBy("key").agg(F.count("*").alias("copies"))
    distinct = counted and stored(counted.withColumn("weight", F.col("copies") if weigh_copies else F.lit(1).cast("long")))
    model = fit(distinct, dimensions, components) if distinct else None
    if model is None:
        return spark.createDataFrame([], f"`{ident}` {kind}, n long, copies long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    once = stored(whiten_distinct(distinct, model, dimensions))
    error = identity_error(once, model)
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.values)).cast("array<double>")
    met = keyed.join(once, "key")
    return met.select(ident, F.lit(model.n).cast("long").alias("n"), "copies", "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    each = found.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get("explained", F.col("place")).alias("explained"),
        "identity_error",
    )
