"""Whitening of embeddings by a covariance weighted with multiplicities.

Entries become integers x = floor(scale * c) + offset. Rows with the same x-vector are one
distinct vector with a count; the fit list is all rows (``weigh=True``) or each distinct
vector once. Sums per dimension are exact integers. Each task centres its distinct vectors
with the exact mean, multiplies them with their weights in one matrix product, and only
that matrix leaves the task; Spark adds the matrices block by block. The eigenvectors of
the covariance whiten each distinct vector once, and rows are joined back to their vector.

The whitened vectors' own covariance is measured in a second pass, centred task by task;
tasks are merged by their means. Only matrices of dimension by dimension come to the driver.

Cases: rows whose vector is null, empty, or has null or non-finite entries are dropped, and
so are those of another length than the most frequent one (of equally frequent ones, the
longest). Entries whose x leaves 62 bits count as the last x inside. Null and repeated ids
are rows like others. Components whose eigenvalue is below ``FLAT`` of the largest have no
direction of their own and are left out; so a table of one distinct vector, like an empty
one, gives no row. Eigenvectors of equal eigenvalues are any basis, the same for all rows.
A deviation that a long can't hold is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm.scratch import Scratch
from tidemark.operators.skew import lookup_join

SCALE, OFFSET = 64.0, 1_000_000
COMPONENTS = 32
#: Share of the largest eigenvalue below which a component is rounding only.
FLAT = 1e-12
#: Rows of a matrix that are added as one group.
_BLOCK = 64
#: Groups of tasks whose matrices are added first.
LANES = 256
#: Vectors that are joined back apart: those with more rows than this, or a share of all.
HOT_LEAST, HOT_SHARE = 20_000, 10_000
_LIMIT = 1 << 62


@dataclass(frozen=True)
class Fit:
    n: int
    sums: list[int]
    #: Columns are components, by falling eigenvalue.
    directions: np.ndarray
    values: np.ndarray
    trace: float


def quantised(rows: DataFrame, vec_id: str, vector: str, scale: float, offset: int) -> DataFrame:
    """(vec_id, x: longs as little-endian bytes) of the rows that count."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = tx.one_array(batch.column(1))
            length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            entries = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries are NaN
            fine = np.isfinite(entries)
            ends, bad = np.cumsum(length), np.r_[0, np.cumsum(~fine)]
            good = np.flatnonzero((length > 0) & (bad[ends] == bad[ends - length]))
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(scale * np.where(fine, entries, 0.0)), -float(_LIMIT), float(_LIMIT)).astype("<i8") + offset
            raw = x.tobytes()
            xs = [raw[8 * (e - n) : 8 * e] for e, n in zip(ends[good].tolist(), length[good].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array(xs, pa.binary())], names=["vec_id", "x"])

    named = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return named.mapInArrow(convert, "vec_id long, x binary")


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, width)


def _exact_sums(parts: DataFrame, width: int, weigh: bool) -> tuple[int, list[int]]:
    """Rows of the fit list and exact sums of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, [0] * width
        for batch in batches:
            x, w = _vectors(batch.column("x"), width), _weights(batch, weigh)
            # Halves of 32 bits, so that no sum of a batch leaves 64 bits.
            high, low = x >> 32, x & 0xFFFFFFFF
            for a in range(0, len(x), 256):
                h, lo, c = high[a : a + 256], low[a : a + 256], w[a : a + 256]
                if c.max(initial=0) < 1 << 22:
                    hs, ls = (c @ h).tolist(), (c @ lo).tolist()
                else:
                    hs, ls = (c.astype(object) @ h.astype(object)).tolist(), (c.astype(object) @ lo.astype(object)).tolist()
                sums = [s + (int(p) << 32) + int(q) for s, p, q in zip(sums, hs, ls, strict=True)]
            total += int(w.sum())
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], names=["n", "s"])

    found = parts.mapInArrow(add, "n long, s array<string>")
    # Sums of tasks are strings of digits: added as decimals, dimension by dimension.
    sums = found.select(F.posexplode("s").alias("d", "s")).groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    n = int(found.agg(F.sum("n")).first()[0] or 0)
    out = [0] * width
    for r in sums.collect():  # one row for each dimension
        out[r.d] = int(r.s)
    return n, out


def _weights(batch: pa.RecordBatch, weigh: bool) -> np.ndarray:
    return batch.column("n").to_numpy(zero_copy_only=False) if weigh else np.ones(batch.num_rows, np.int64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: as longs where they fit, else as Python integers."""
    largest = max(int(np.abs(x).max(initial=0)) * n, *(abs(s) for s in sums)) if len(x) else 0
    if largest < _LIMIT:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, rounded once."""
    return (deviations(x, n, sums) / n).astype(np.float64)


def _add_matrices(parts: DataFrame, width: int) -> np.ndarray:
    """Sum of (block, body) pieces of square matrices; the sums are made on Spark."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.float64) for b in table.column("body").to_pylist())
        return pa.table({"block": table.column("block")[:1], "body": pa.array([total.tobytes()], pa.binary())})

    # First inside groups of tasks, then over these: no group holds the pieces of all tasks.
    some = parts.groupBy("block", "lane").applyInArrow(lambda t: add(t), "block int, body binary")
    out = np.zeros((width, width))
    for r in some.groupBy("block").applyInArrow(lambda t: add(t), "block int, body binary").collect():
        body = np.frombuffer(r["body"], np.float64).reshape(-1, width)
        out[r["block"] * _BLOCK : r["block"] * _BLOCK + len(body)] = body
    return out


def _pieces(matrix: np.ndarray) -> pa.RecordBatch:
    at = range(0, len(matrix), _BLOCK)
    body = [matrix[a : a + _BLOCK].tobytes() for a in at]
    columns = [pa.array([a // _BLOCK for a in at], pa.int32()), pa.array([_lane()] * len(body), pa.int32()), pa.array(body, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["block", "lane", "body"])


def _lane() -> int:
    """The group of a task: the same when the task runs again."""
    return TaskContext.get().partitionId() % LANES


def fit(parts: DataFrame, width: int, weigh: bool, components: int) -> Fit | None:
    """The covariance of the fit list and its main directions."""
    n, sums = _exact_sums(parts, width, weigh)
    if not n:
        return None

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            c = centred(_vectors(batch.column("x"), width), n, sums)
            total += c.T @ (c * _weights(batch, weigh)[:, None])
        yield _pieces(total)

    covariance = _add_matrices(parts.mapInArrow(scatter, "block int, lane int, body binary"), width) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(values)[::-1][:components]
    order = order[values[order] > max(0.0, FLAT * values.max())]
    return Fit(n, sums, np.ascontiguousarray(vectors[:, order]), values[order], float(np.trace(covariance)))


def whitened_vectors(parts: DataFrame, width: int, found: Fit) -> DataFrame:
    """Distinct vectors (x, n) with deviation (as digits) and whitened."""

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = found.directions / np.sqrt(found.values)
        for batch in batches:
            x = _vectors(batch.column("x"), width)
            d = deviations(x, found.n, found.sums)
            if int(np.abs(d).max(initial=0)) ** 2 * width < _LIMIT:
                squares = (d * d).sum(axis=1).tolist()
            else:
                squares = [sum(e * e for e in row) for row in d.tolist()]
            w = (d / found.n).astype(np.float64) @ scale
            yield pa.RecordBatch.from_arrays(
                [batch.column("x"), batch.column("n"), pa.array([str(s) for s in squares], pa.string()), pa.array(w.tolist(), pa.list_(pa.float64()))],
                names=["x", "n", "deviation", "whitened"],
            )

    return parts.mapInArrow(whiten, "x binary, n long, deviation string, whitened array<double>")


def identity_error(distinct: DataFrame, count: int, weigh: bool) -> float:
    """Largest absolute entry of the whitened covariance minus the identity."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row and column hold the weight and the sums, to merge tasks by.
        total, mean, weight = np.zeros((count, count)), np.zeros(count), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.array(batch.column("whitened").to_pylist())
            w = _weights(batch, weigh).astype(np.float64)
            own = w @ v / w.sum()
            c, step = v - own, own - mean
            both = weight + w.sum()
            total += c.T @ (c * w[:, None]) + np.outer(step, step) * weight * w.sum() / both
            mean, weight = mean + step * w.sum() / both, both
        if weight:
            yield pa.RecordBatch.from_arrays(
                [pa.array([_lane()], pa.int32()), pa.array([weight]), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))],
                names=["lane", "w", "m", "s"],
            )

    def merge(table: pa.Table) -> pa.Table:
        w, m, s = (np.array(table.column(c).to_pylist()) for c in ("w", "m", "s"))
        mean = w @ m / w.sum()
        step = m - mean
        total = s.sum(axis=0) + (step.T @ (step * w[:, None])).ravel()
        lane = pa.array([0], pa.int32())
        return pa.table({"lane": lane, "w": [w.sum()], "m": pa.array([mean.tolist()], pa.list_(pa.float64())), "s": pa.array([total.tolist()], pa.list_(pa.float64()))})

    kind = "lane int, w double, m array<double>, s array<double>"
    some = distinct.mapInArrow(scatter, kind).groupBy("lane").applyInArrow(lambda t: merge(t), kind)
    done = some.groupBy("lane").applyInArrow(lambda t: merge(t), kind).first()  # one row of each lane
    covariance = np.array(done.s).reshape(count, count) / done.w
    return float(np.abs(covariance - np.eye(count)).max())


_ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(
    rows: DataFrame,
    components: int = COMPONENTS,
    weigh: bool = True,
    scale: float = SCALE,
    offset: int = OFFSET,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """For each remaining row and component: vec_id, component, n (of the fit list), deviation
    (sum of (n * x - S)^2), whitened, explained (eigenvalue over trace), identity_error."""
    spark = rows.sparkSession
    work = Scratch(spark, "whitening")
    kept = work.save(quantised(rows, vec_id, vector, scale, offset), "rows")
    sizes = kept.groupBy(F.octet_length("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return spark.createDataFrame([], _ROWS)
    width = sizes["size"] // 8
    kept = kept.where(F.octet_length("x") == sizes["size"])
    parts = work.save(kept.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "distinct")
    found = fit(parts, width, weigh, components)
    if found is None or not len(found.values):
        return spark.createDataFrame([], _ROWS)
    distinct = work.save(whitened_vectors(parts, width, found), "whitened")
    error = identity_error(distinct, len(found.values), weigh)
    work.drop("distinct")
    back = lookup_join(kept, distinct.drop("n"), "x", max(HOT_LEAST, sizes["count"] // HOT_SHARE))
    explained = F.array(*[F.lit(float(v / found.trace)) for v in found.values])
    each = back.select("vec_id", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(found.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
