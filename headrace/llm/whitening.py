"""Operator 13: whitening of embeddings from exact integer cross-products.

Entries become integers. A block's entries, less the least of their dimension, are cut into bit planes, and
each plane packs its rows into 64-bit words; a cross-product is a sum of popcounts of ANDed planes,
weighted by powers of two. Sums over blocks and the centring are exact; only then floats begin.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headrace.llm.common import find_code, stored

#: x = floor(SCALE c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Components that are returned, at most.
COMPONENTS = 8
#: Rows whose planes are packed together.
BLOCK_ROWS = 16_384
#: Larger magnitudes of x would leave the exact range of doubles and longs.
MOST = 2.0**52


def whole_vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, x as a matrix) for each length among the vectors that hold only finite numbers."""
    column = pa.concat_arrays([column]) if column.offset else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values
    entries = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # NULL becomes NaN
    lengths = np.diff(offsets)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    usable = (bad[offsets[1:]] == bad[offsets[:-1]]) & (lengths > 0)
    if column.null_count:
        usable &= column.is_valid().to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(lengths[usable]).tolist():
        rows = np.flatnonzero(usable & (lengths == d))
        x = np.floor(SCALE * entries[offsets[rows][:, None] + np.arange(d)])
        if np.abs(x).max(initial=0) > MOST:
            raise ValueError("embedding entries must stay below 2^42 in magnitude")
        out.append((rows, x.astype(np.int64) + OFFSET))
    return out


def bit_planes(y: np.ndarray) -> np.ndarray:
    """(dimension, bit, word) planes of non-negative rows ``y``: bit r of the words is row r's."""
    bits = max(1, int(y.max(initial=0)).bit_length())
    rows = -(-len(y) // 64) * 64
    turned = np.zeros((y.shape[1], rows), np.int64)
    turned[:, :len(y)] = y.T
    planes = [np.packbits(((turned >> b) & 1).astype(np.uint8), axis=1).view(np.uint64) for b in range(bits)]
    return np.stack(planes, axis=1)


def cross_products(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """(sums, sums of products of every two columns) of integer rows, exact."""
    least = x.min(0)
    planes = bit_planes(x - least)
    d, bits, words = planes.shape
    flat = planes.reshape(d * bits, words)
    counts = np.zeros((d * bits, d * bits), np.int64)
    for k in range(d * bits):
        first = k // bits * bits
        counts[k, first:] = np.bitwise_count(flat[first:] & flat[k]).sum(1, dtype=np.int64)
    kind = np.int64 if 2 * bits + len(x).bit_length() < 63 else object
    weight = np.array([1 << b for b in range(bits)], kind)
    by_dim = counts.reshape(d, bits, d, bits).astype(kind)
    products = (by_dim * weight[None, :, None, None] * weight).sum((1, 3)).tolist()
    ones = np.bitwise_count(flat).sum(1, dtype=np.int64).reshape(d, bits).astype(kind)
    y = (ones * weight).sum(1).tolist()
    low, n = least.tolist(), len(x)
    sums = [a + n * m for a, m in zip(y, low)]
    return sums, [[products[i][j] + low[i] * y[j] + low[j] * y[i] + n * low[i] * low[j] if j >= i else 0 for j in range(d)] for i in range(d)]


def scatter(vectors: DataFrame) -> DataFrame:
    """(d, i, j, total) for each length d: exact cross-products of dimensions i <= j.

    i = -1 holds the sum of dimension j, and i = j = -1 the number of rows.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}  # per length: rows, sums, products
        held: dict[int, list[np.ndarray]] = {}

        def add(d: int):
            x = np.concatenate(held.pop(d))
            for at in range(0, len(x), BLOCK_ROWS):
                part = x[at:at + BLOCK_ROWS]
                sums, products = cross_products(part)
                total = totals.setdefault(d, [0, np.zeros(d, object), np.zeros((d, d), object)])
                total[0] += len(part)
                total[1] += np.array(sums, object)
                total[2] += np.array(products, object)

        for b in batches:
            for _, x in whole_vectors(b.column("v")):
                d = x.shape[1]
                held.setdefault(d, []).append(x)
                if sum(map(len, held[d])) >= BLOCK_ROWS:
                    add(d)
        for d in list(held):
            add(d)
        for d, (n, sums, products) in totals.items():
            i, j = np.triu_indices(d)
            values = [n, *sums.tolist(), *products[i, j].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(values), d, np.int32)), pa.array(np.concatenate([np.full(d + 1, -1), i]).astype(np.int32)),
                 pa.array(np.concatenate([[-1], np.arange(d), j]).astype(np.int32)), pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))],
                names=["d", "i", "j", "total"])

    return vectors.mapInArrow(rows, "d int, i int, j int, total decimal(38,0)").groupBy("d", "i", "j").agg(F.sum("total").alias("total"))


class Whitening:
    """What the fit list determines: n, sums, covariance and the components with variance."""

    def __init__(self, rows: list, components: int):
        self.d = rows[0]["d"] if rows else 0
        self.sums = [0] * self.d
        products = np.zeros((self.d, self.d), object)
        self.n = 0
        for r in rows:
            i, j, total = r["i"], r["j"], int(r["total"])
            if j < 0:
                self.n = total
            elif i < 0:
                self.sums[j] = total
            else:
                products[i, j] = products[j, i] = total
        s = np.array(self.sums, object)
        centred = self.n * products - np.outer(s, s)  # n^2 times the covariance, exact
        square = self.n * self.n
        covariance = np.array([[value / square for value in line] for line in centred.tolist()], np.float64).reshape(self.d, self.d)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        trace = int(np.trace(centred)) / square if self.d else 0.0
        self.explained = [float(values[k] / trace) if trace else None for k in order]
        top = float(values.max(initial=0.0))
        self.has_variance = [bool(values[k] > top * self.d * np.finfo(float).eps) for k in order]
        scale = np.array([1 / np.sqrt(values[k]) if ok else 0.0 for k, ok in zip(order, self.has_variance)])
        self.projection = vectors[:, order] * scale


def projected(x: np.ndarray, n: int, sums: list[int], projection: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(sum of (n x - S)^2, whitened vector) of each row. Integers stay exact beyond 64 bits."""
    wide = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) >= 1 << 62
    kind = object if wide else np.int64
    apart = x.astype(kind) * n - np.array(sums, kind)
    most = int(np.abs(apart).max(initial=0))
    squares = apart if most * most * x.shape[1] < 1 << 63 else apart.astype(object)
    return (squares * squares).sum(1).tolist(), (apart / n).astype(np.float64) @ projection


def whitened(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per kept row and component.

    Rows whose vector is NULL, empty, or holds NULL or non-finite entries are left out; so are vectors shorter than
    the longest one, which lack entries. A NULL id and repeated rows stay, and each counts. ``deviation`` is an
    exact decimal. A component without variance has the whitened value NULL and no part in ``identity_error``,
    which is measured on the whitened rows. No usable rows: no rows. Extra columns are ignored.
    Entries of 2^42 and more in magnitude raise an error.
    """
    find_code(vectors.sparkSession)
    asked = vectors.select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("v"))
    partial = stored(scatter(asked.select("v")))
    longest = partial.agg(F.max("d").alias("d")).first()["d"] or 0
    fit = Whitening(partial.filter(F.col("d") == longest).collect(), components)  # longest^2 / 2 rows, as many as eigh needs
    kind = asked.schema["id"].dataType.simpleString()
    n, sums, projection = fit.n, fit.sums, fit.projection

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in whole_vectors(b.column("v")):
                if x.shape[1] != longest:
                    continue
                deviation, w = projected(x, n, sums, projection)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(at)), pa.array([Decimal(v) for v in deviation], pa.decimal128(38, 0)),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))],
                    names=["id", "deviation", "w"])

    done = stored(asked.mapInArrow(rows, f"id {kind}, deviation decimal(38,0), w array<double>"))
    live = [k for k, ok in enumerate(fit.has_variance) if ok]
    pairs = [(a, b) for a in live for b in live if a <= b]
    error = None
    if pairs:
        measured = done.agg(*[F.covar_pop(F.col("w")[a], F.col("w")[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
        error = max(abs(measured[f"c{a}_{b}"] - (a == b)) for a, b in pairs)
    table = F.array(*[F.struct(F.lit(k + 1).alias("component"), (F.col("w")[k] if ok else F.lit(None).cast("double")).alias("whitened"),
                               F.lit(e).cast("double").alias("explained")) for k, (ok, e) in enumerate(zip(fit.has_variance, fit.explained))])
    if not fit.explained:
        table = F.array().cast("array<struct<component:int,whitened:double,explained:double>>")
    return done.select(F.col("id").alias(id_column), "deviation", F.explode(table).alias("c")).select(
        id_column, "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"))
