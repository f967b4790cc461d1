"""Whitening of embeddings by exact covariances from bit-sliced scatter.

Entries become integers, x = floor(256 c). The covariance is that of the fit list, in which
every vector of integers stands once. Blocks of the fit list are shifted so that each dimension
starts at zero and are packed into bit planes: one word holds one bit of one dimension of 64
rows. The number of bits that two planes share, weighted with both planes' powers of two, adds
up to the exact sum of products; shifts are taken back in whole numbers, the blocks' sums are
added by Spark, and n·Σxy − Σx·Σy is centred exactly before anything is a float. Only sums, as
many as a pair of dimensions, reach the driver, which takes the eigenvectors.

Defined cases: rows whose vector is null or holds a null or an entry that isn't finite are left
out; vectors of different lengths are whitened apart, each by the fit list of its length; empty
vectors have no component; entries beyond a long count as the nearest long; a component without
variance has a null `whitened`; repeated rows and null ids are rows like others; an empty table
gives no rows; further columns of the input are ignored.
"""
from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grid import stored

SCALE = 256
COMPONENTS = 4
# Rows of a block, and values that it holds at most.
BLOCK_ROWS, BLOCK_VALUES = 16_384, 2_000_000
# Sums travel as digits of 32 bits, the last one signed, so that Spark adds them as longs.
DIGITS = 5
# Variance that counts as none, as a share of all variance.
NO_VARIANCE = 1e-13

_U = np.uint64


def _block_rows(dim: int) -> int:
    return max(64, min(BLOCK_ROWS, BLOCK_VALUES // max(dim, 1)) // 64 * 64)


def integers(batch: pa.RecordBatch, column: str):
    """Of a batch's usable rows, by length of their vectors: (length, row numbers, integers)."""
    lists = batch.column(column).cast(pa.list_(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
    starts = np.cumsum(lengths) - lengths
    bad = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[~np.isfinite(values)], minlength=len(lengths)) > 0
    usable = ~bad & lists.is_valid().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[usable]):
        rows = np.flatnonzero(usable & (lengths == dim))
        for at in range(0, len(rows), _block_rows(dim)):
            some = rows[at:at + _block_rows(dim)]
            with np.errstate(over="ignore"):
                scaled = np.floor(values[starts[some][:, None] + np.arange(dim)] * SCALE)
            x = np.clip(scaled, -2.0**63, 2.0**63 - 1024).astype(np.int64)
            x[scaled >= 2.0**63] = np.iinfo(np.int64).max
            yield int(dim), some, x


def _packed(batches):
    """(dim, x): the integers of a vector in as few bytes each as its largest one needs."""
    for batch in batches:
        for dim, _, x in integers(batch, "v"):
            if not dim:
                continue
            largest = np.maximum(x.max(axis=1), ~x.min(axis=1))
            width = np.select([largest < 1 << 7, largest < 1 << 15, largest < 1 << 31], [1, 2, 4], 8)
            for w in np.unique(width):
                rows = x[width == w].astype(f"<i{w}")
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (dim * int(w)))
                data = pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets.buffers()[1], pa.py_buffer(rows.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), dim, np.int32)), data], ["dim", "x"])


def _unpacked(batches):
    """Blocks (length, integers) of packed rows, in order of neither."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        sizes = pc.binary_length(batch.column("x")).to_numpy()
        for dim, size in set(zip(dims.tolist(), sizes.tolist())):
            some = batch.column("x").filter(pa.array((dims == dim) & (sizes == size)))
            x = np.frombuffer(b"".join(some.to_pylist()), f"<i{size // dim}").reshape(-1, dim).astype(np.int64)
            rows = _block_rows(dim)
            for at in range(0, len(x), rows):
                part = held.setdefault(dim, [])
                part.append(x[at:at + rows])
                if sum(map(len, part)) >= rows:
                    yield dim, np.concatenate(held.pop(dim))
    for dim, part in held.items():
        yield dim, np.concatenate(part)


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes × words of unsigned rows, with each plane's dimension and bit, by dimension."""
    rows, dims = y.shape
    highest = np.bitwise_or.reduce(y, axis=0)
    planes, dim, bit = [], [], []
    for b in range(int(highest.max()).bit_length()):
        with_it = np.flatnonzero(highest >> _U(b))
        packed = np.packbits(((y[:, with_it] >> _U(b)) & _U(1)).astype(np.uint8), axis=0)
        padded = np.zeros((len(with_it), -(-rows // 64) * 8), np.uint8)
        padded[:, :len(packed)] = packed.T
        planes.append(padded.view(_U))
        dim.append(with_it)
        bit.append(np.full(len(with_it), b))
    if not planes:
        return np.zeros((0, 0), _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    planes, dim, bit = np.concatenate(planes), np.concatenate(dim), np.concatenate(bit)
    order = np.lexsort((bit, dim))
    return planes[order], dim[order], bit[order]


def _bits_in_common(planes: np.ndarray, plane: np.ndarray) -> np.ndarray:
    return np.bitwise_count(planes & plane).sum(axis=1, dtype=np.uint32).astype(np.int64)


def _weighted(counts: np.ndarray, shift: np.ndarray, into: np.ndarray, at) -> None:
    """Add counts · 2^shift to digits of 32 bits."""
    np.add.at(into, (*at, shift >> 5), counts << (shift & 31))


def _as_numbers(digits: np.ndarray) -> np.ndarray:
    """Python's integers of arrays of digits (which may be larger than a digit)."""
    out = np.zeros(digits.shape[:-1], object)
    for k in range(digits.shape[-1]):
        if digits[..., k].any():
            out = out + digits[..., k].astype(object) * (1 << 32 * k)
    return out


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of a block's rows, and of the products of dimensions i <= j (as of
    `triu_indices`), as Python's integers."""
    n, dims = x.shape
    low = x.min(axis=0)
    planes, dim, bit = bit_planes(x.view(_U) - low.view(_U))  # differences fit 64 bits unsigned
    sums = np.zeros((dims, DIGITS), np.int64)
    _weighted(np.bitwise_count(planes).sum(axis=1, dtype=np.int64), bit, sums, (dim,))
    products = np.zeros((dims, dims, DIGITS), np.int64)
    first = np.searchsorted(dim, np.arange(dims + 1))
    for d in range(dims):
        rest = planes[first[d]:]
        for p in range(first[d], first[d + 1]):
            _weighted(_bits_in_common(rest, planes[p]), bit[p] + bit[first[d]:], products, (d, dim[first[d]:]))
    i, j = np.triu_indices(dims)
    low, sums, products = low.astype(object), _as_numbers(sums), _as_numbers(products[i, j])
    return sums + n * low, products + low[i] * sums[j] + low[j] * sums[i] + n * low[i] * low[j]


SUMS = "dim int, i int, j int, " + ", ".join(f"d{k} long" for k in range(DIGITS))


def _scattered(batches):
    """Digits of the number of rows (i = j = -1), of the sums (i = -1) and of the products."""
    total: dict[int, list] = {}
    for dim, x in _unpacked(batches):
        own = total.setdefault(dim, [0, 0, 0])
        for k, part in enumerate((len(x), *scatter(x))):
            own[k] = own[k] + part
    for dim, (n, sums, products) in total.items():
        i, j = (np.concatenate([[-1], np.full(dim, -1), ij]) if k == 0 else np.concatenate([[-1], np.arange(dim), ij])
                for k, ij in enumerate(np.triu_indices(dim)))
        every = [n, *sums, *products]
        digits = [[(v >> 32 * k) & 0xFFFFFFFF if k < DIGITS - 1 else v >> 32 * k for v in every] for k in range(DIGITS)]
        arrays = [pa.array(np.full(len(every), dim), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(d, pa.int64()) for d in digits)]
        yield pa.RecordBatch.from_arrays(arrays, ["dim", "i", "j", *(f"d{k}" for k in range(DIGITS))])


class Model:
    """Mean (as sums and n) and the first components of a fit list."""

    def __init__(self, n: int, sums: list[int], products: dict[tuple[int, int], int], components: int):
        dim = len(sums)
        self.n, self.sums = n, sums
        exact = {(i, j): n * p - sums[i] * sums[j] for (i, j), p in products.items()}
        covariance = np.zeros((dim, dim))
        for (i, j), v in exact.items():
            covariance[i, j] = covariance[j, i] = v / (n * n)
        trace = sum(exact[i, i] for i in range(dim)) / (n * n)
        values, vectors = np.linalg.eigh(covariance)
        first = np.argsort(-values, kind="stable")[:components]
        self.values, vectors = values[first], vectors[:, first]
        # either sign will do: the largest entry is positive
        self.vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(first))] < 0, -1.0, 1.0)
        self.varies = self.values > NO_VARIANCE * trace
        self.explained = np.where(self.varies, self.values / trace, 0.0) if trace else np.zeros(len(first))

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n·x − S, and the sums of its squares over the dimensions, both exact."""
        bound = self.n * max(int(x.max()), -int(x.min())) + max(map(abs, self.sums))
        exact = x.dtype if bound < 1 << 63 else object
        off = self.n * x.astype(exact) - np.array(self.sums, exact)
        squares = off if len(self.sums) * bound * bound < 1 << 63 else off.astype(object)
        return off, (squares * squares).sum(axis=1)

    def whitened(self, off: np.ndarray) -> np.ndarray:
        """Rows × components, NaN for components without variance."""
        scale = np.sqrt(np.where(self.varies, self.values, np.nan))
        return (off.astype(np.float64) / self.n) @ self.vectors / scale


def _moments(batches, models):
    """Sums (i = -1) of the whitened components and of their products over the fit list."""
    total: dict[int, list] = {}
    for dim, x in _unpacked(batches):
        w = models[dim].whitened(models[dim].deviations(x)[0])
        own = total.setdefault(dim, [0, 0])
        own[0], own[1] = own[0] + w.sum(axis=0), own[1] + w.T @ w
    for dim, (sums, products) in total.items():
        k = len(sums)
        i, j = (a.ravel() for a in np.indices((k, k)))
        arrays = [
            pa.array(np.full(k + k * k, dim), pa.int32()), pa.array(np.concatenate([np.full(k, -1), i]), pa.int32()),
            pa.array(np.concatenate([np.arange(k), j]), pa.int32()), pa.array(np.concatenate([sums, products.ravel()])),
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["dim", "i", "j", "value"])


def _rows(batches, models, errors):
    for batch in batches:
        for dim, rows, x in integers(batch, "v"):
            if not dim:
                continue
            model = models[dim]
            k = len(model.values)
            off, squares = model.deviations(x)
            if squares.dtype == object:
                squares = pa.array([v if v < 10**38 else None for v in squares.tolist()], pa.decimal128(38, 0))
            else:
                squares = pa.array(squares).cast(pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(len(rows)), k))
            n = len(each)
            whitened = model.whitened(off).ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(rows)).take(each), pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()),
                pa.array(np.full(n, model.n, np.int64)), squares.take(each), pa.array(whitened, mask=np.isnan(whitened)),
                pa.array(np.tile(model.explained, len(rows))), pa.array(np.full(n, errors[dim]), pa.float64(), mask=np.full(n, math.isnan(errors[dim]))),
            ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def fit(vectors: DataFrame, column: str, components: int = COMPONENTS) -> tuple[DataFrame, dict[int, Model]]:
    """The stored fit list and, by length of vectors, what was learned from it."""
    packed = vectors.select(vectors[column].alias("v")).mapInArrow(_packed, "dim int, x binary")
    listed = stored(packed.distinct())
    sums = listed.mapInArrow(_scattered, SUMS).groupBy("dim", "i", "j").agg(*[F.sum(f"d{k}").alias(f"d{k}") for k in range(DIGITS)])
    found: dict[int, dict] = {}
    for r in sums.toLocalIterator():  # a row for each pair of dimensions, however many vectors
        found.setdefault(r.dim, {})[r.i, r.j] = sum(r[f"d{k}"] << 32 * k for k in range(DIGITS))
    models = {}
    for dim, own in found.items():
        totals = [own.pop((-1, j)) for j in range(dim)]
        models[dim] = Model(own.pop((-1, -1)), totals, own, components)
    return listed, models


def identity_errors(listed: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """How far the whitened fit list's covariance is from the identity, measured over the list:
    its largest absolute difference; NaN where no component varies."""
    sums = listed.mapInArrow(partial(_moments, models=models), "dim int, i int, j int, value double").groupBy("dim", "i", "j").agg(F.sum("value").alias("value"))
    found: dict[int, dict] = {}
    for r in sums.toLocalIterator():
        found.setdefault(r.dim, {})[r.i, r.j] = r.value
    errors = {}
    for dim, model in models.items():
        own, varies = found[dim], np.flatnonzero(model.varies)
        mean = {i: own[-1, i] / model.n for i in varies}
        errors[dim] = max((abs(own[i, j] / model.n - mean[i] * mean[j] - (i == j)) for i in varies for j in varies), default=math.nan)
    return errors


def whiten(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: its id, component, n (vectors of the fit
    list), deviation (decimal; null beyond 38 digits), whitened, explained, identity_error."""
    listed, models = fit(vectors, column, components)
    errors = identity_errors(listed, models)
    rows = vectors.select(vectors[id_col].alias("id"), vectors[column].alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(
        partial(_rows, models=models, errors=errors),
        f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
