"""Embedding whitening: covariance of distinct vectors, weighted by how often each occurs."""

from __future__ import annotations

import sys
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import pin

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Rows that a matrix product takes at a time.
ROWS = 4096
#: A vector with at least one in HOT of all rows is dealt to HOT tasks when it is joined back;
#: there are at most HOT such vectors.
HOT = 64


def grid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): floor(64 c) + 1000000 of every entry c, for rows whose vector is neither null nor
    holds null or non-finite entries. Entries from 2 ** 56 on have no such 64-bit number, so their
    rows go as well."""
    v = F.col(vector_col)
    fits = F.forall(v, lambda c: F.coalesce((F.abs(c) < float(1 << 56)) & ~F.isnan(c), F.lit(False)))
    return vectors.where(v.isNotNull() & fits & (F.size(v) > 0)).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET).alias("x"))


def matrices(batch: pa.RecordBatch, column: str):
    """(rows, values) for each vector length of a batch, at most ROWS rows each."""
    lists = batch.column(column)
    bounds = lists.offsets.to_numpy()
    values, width = lists.values.to_numpy(zero_copy_only=False), np.diff(bounds)
    for w in np.unique(width):
        found = np.flatnonzero(width == w)
        for lo in range(0, len(found), ROWS):
            rows = found[lo:lo + ROWS]
            yield rows, values[bounds[rows][:, None] + np.arange(w)]


def integer_sums(x: np.ndarray, weight: np.ndarray) -> list[int]:
    """Exact weighted sums of the columns."""
    if float(np.abs(x).max(initial=0)) * float(weight.sum()) < 2 ** 62:
        return (weight @ x).tolist()
    return [sum(int(a) * int(w) for a, w in zip(col, weight, strict=True)) for col in x.T]


def lists_of(values: np.ndarray) -> pa.ListArray:
    """One list for each row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()),
                                    pa.array(values.ravel()))


class Centre:
    """Exact means of one vector length: sums S of n vectors as S = n * whole + rest."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n with one rounding, as the whole part is taken off before."""
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S) ** 2; null beyond 64 bits."""
        near = x - self.whole
        far = float(np.abs(near).max(initial=0)) * self.n + self.n
        if far * far * x.shape[1] < 2 ** 62:
            return ((near * self.n - self.rest) ** 2).sum(axis=1).tolist()
        totals = (sum((int(a) * self.n - int(r)) ** 2 for a, r in zip(row, self.rest, strict=True)) for row in near)
        return [t if t < 1 << 63 else None for t in totals]


class Whitener:
    """Leading components of one vector length, and what maps a centred vector onto them."""

    def __init__(self, centre: Centre, covariance: np.ndarray, most: int):
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:most]
        trace = float(np.trace(covariance))
        self.centre, self.values = centre, values[order]
        #: Directions without variance have no unit scale: their whitened values are null.
        self.live = self.values > max(float(values.max(initial=0)), 0.0) * len(values) * np.finfo(np.float64).eps
        self.map = vectors[:, order] / np.sqrt(np.where(self.live, self.values, 1.0))
        self.map[:, ~self.live] = np.nan
        self.explained = [float(v) / trace if trace > 0 else None for v in self.values]


def sum_of_products(pairs: DataFrame, column: str, weight: str, centred) -> dict[int, np.ndarray]:
    """Weighted sums of outer products of centred vectors, by vector length. Every task sums
    its own rows in one matrix a length; Spark adds these entry by entry, and what comes to the
    driver is a matrix of length x length numbers."""
    def gemm(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            weights = batch.column(weight).to_numpy()
            for rows, values in matrices(batch, column):
                d = centred(values)
                sums[d.shape[1]] = sums.get(d.shape[1], 0) + (d * weights[rows, None]).T @ d
        for w, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(w, w)), pa.array(np.arange(w)), lists_of(total)],
                                             names=["width", "i", "row"])
    rows = pairs.mapInArrow(gemm, "width long, i long, row array<double>")
    entries = rows.select("width", "i", F.posexplode("row").alias("j", "v")).where("j <= i")
    out: dict[int, np.ndarray] = {}
    for r in entries.groupBy("width", "i", "j").agg(F.sum("v").alias("v")).collect():
        m = out.setdefault(r.width, np.zeros((r.width, r.width)))
        m[r.i, r.j] = m[r.j, r.i] = r.v
    return out


def centres(distinct: DataFrame) -> dict[int, Centre]:
    """Exact count and sums by vector length."""
    def add(batches):
        for batch in batches:
            weights = batch.column("weight").to_numpy()
            for rows, x in matrices(batch, "x"):
                sums = [Decimal(s) for s in integer_sums(x, weights[rows])]
                w = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(w, w)), pa.array(np.arange(w)), pa.array(sums, pa.decimal128(38, 0)),
                     pa.array(np.full(w, weights[rows].sum()))], names=["width", "i", "s", "n"])
    sums = distinct.select("x", "weight").mapInArrow(add, "width long, i long, s decimal(38,0), n long")
    found: dict[int, list] = {}
    for r in sums.groupBy("width", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        found.setdefault(r.width, []).append((r.i, int(r.s), r.n))
    return {w: Centre(parts[0][2], [s for _, s, _ in sorted(parts)]) for w, parts in found.items()}


def whitened_vectors(vectors: DataFrame, components: int = COMPONENTS, multiplicity: bool = True,
                     id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row of *vectors* and
    leading component; columns beside the two named are ignored.

    Equal vectors on the grid of :func:`grid_vectors` are grouped. Fit weights are their
    counts, or one for each with ``multiplicity=False``. Sums are exact; the covariance (divisor: sum
    of weights) is a product of centred distinct vectors. Each distinct vector is whitened once and joined back to its rows.

    Vectors of another length are a fit of their own (one matrix of length x length numbers each on
    the driver); an empty vector has no components and gives no rows. A null id stays,
    repeated ids are rows like others. Without variance, as with a single vector, ``whitened`` is null, and so is
    ``explained`` if no component has any; ``identity_error`` covers the components with variance, null
    if there are none. ``deviation`` is null beyond 64 bits. An empty table gives no rows.
    """
    rows = grid_vectors(vectors, id_col, vector_col)
    h1, h2 = F.xxhash64(F.lit(1), "x").alias("h1"), F.xxhash64(F.lit(2), "x").alias("h2")
    distinct = pin(rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
                   .withColumn("weight", F.col("copies") if multiplicity else F.lit(1).cast("long")))
    centre = centres(distinct)
    by_width = {w: c.centred for w, c in centre.items()}
    products = sum_of_products(distinct.select("x", "weight"), "x", "weight", lambda x: by_width[x.shape[1]](x))
    fits = {w: Whitener(c, products[w] / c.n, components) for w, c in centre.items()}

    def whiten(batches):
        for batch in batches:
            for at, x in matrices(batch, "x"):
                fit = fits[x.shape[1]]
                values = fit.centre.centred(x) @ fit.map
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [own.column("h1"), own.column("h2"), own.column("copies"), own.column("weight"),
                     pa.array(np.full(len(at), x.shape[1])), pa.array(fit.centre.deviations(x), pa.int64()),
                     lists_of(values)],
                    names=["h1", "h2", "copies", "weight", "width", "deviation", "values"])
    white = pin(distinct.select("x", h1, h2, "copies", "weight").mapInArrow(
        whiten, "h1 long, h2 long, copies long, weight long, width long, deviation long, values array<double>"))
    errors = identity_errors(white, fits)

    def per_width(kind: str, of) -> F.Column:
        """A column that is constant for each vector length, as a literal of the plan."""
        out = F.lit(None).cast(kind)
        for w, fit in fits.items():
            out = F.when(F.col("width") == w, F.lit(of(w, fit)).cast(kind)).otherwise(out)
        return out

    total = sum(c.n for c in centre.values()) if multiplicity else distinct.agg(F.sum("copies")).first()[0] or 0
    is_hot = F.col("copies") * HOT >= F.lit(total)
    hot = F.broadcast(white.where(is_hot).select("h1", "h2", F.lit(HOT).alias("ways")))  # at most HOT rows
    keyed = rows.select("vec_id", h1, h2).join(hot, ["h1", "h2"], "left")
    dealt = keyed.withColumn("way", F.when(F.col("ways").isNotNull(), F.floor(F.rand(3) * HOT).cast("int")).otherwise(0))
    spread = white.withColumn("way", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT - 1))).otherwise(F.array(F.lit(0)))))
    joined = dealt.join(spread, ["h1", "h2", "way"])
    value = F.when(F.isnan("value"), F.lit(None)).otherwise(F.col("value"))
    return joined.select("vec_id", "width", "deviation", F.posexplode("values").alias("place", "value")).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"),
        per_width("long", lambda w, f: f.centre.n).alias("n"), "deviation", value.alias("whitened"),
        F.get(per_width("array<double>", lambda w, f: f.explained), "place").alias("explained"),
        per_width("double", lambda w, f: errors.get(w)).alias("identity_error"))


def identity_errors(white: DataFrame, fits: dict[int, Whitener]) -> dict[int, float]:
    """By vector length: the largest entry of the covariance of the whitened vectors minus the
    identity, over the components that have variance. Whitened vectors are centred on their own
    means before the product."""
    live = {w: np.flatnonzero(f.live) for w, f in fits.items()}
    entries = white.select("width", "weight", F.posexplode("values").alias("place", "v"))
    means = {w: np.zeros(len(f.live)) for w, f in fits.items()}
    for r in entries.groupBy("width", "place").agg(F.sum(F.col("v") * F.col("weight")).alias("s")).collect():
        means[r.width][r.place] = r.s / fits[r.width].centre.n
    out = {}
    for w, at in live.items():  # one product for each vector length
        if len(at):
            mean = means[w][at]
            found = sum_of_products(white.where(F.col("width") == w).select("values", "weight"), "values", "weight",
                                    lambda v, at=at, mean=mean: v[:, at] - mean)
            out[w] = float(np.abs(found[len(at)] / fits[w].centre.n - np.eye(len(at))).max())
    return out
