"""Exact similarity joins of unit vectors, by blocks that bounds rule out.

Rows carry a *signature*: a unit vector whose product with another one is never
below the cosine of the two rows (for dense vectors it is the cosine).  A text
has its weights of the most frequent terms and, as one more component, the norm
of all others (by Cauchy and Schwarz these add at most the product of the two
norms); its other terms travel as a tail, from which the exact cosine is made.

* Angles obey the triangle inequality.  A few reference points, far apart, are
  drawn from a bounded sample.  Rows go to the nearest one's cell, cells are cut
  into rings of about equal size by the distance to it, and each block (cell and
  ring) knows the least and the greatest distance of its rows to every reference
  point.
* Threshold join: a pair of blocks is formed only if the intervals of no
  reference point are farther apart than the threshold's angle.  A self join
  forms each unordered pair of blocks once.
* Top-k join: each query first meets the block that its bounds put nearest; its
  k-th best there is the angle that other blocks have to beat to be met at all.
* In a task, signatures are multiplied in numpy; only pairs whose product reaches
  the bound have their exact cosine taken from the tails.

Blocks with many rows (one vector in a third of all rows lies in one ring) are
dealt out in units by a hash of the id.  The driver holds reference points and
intervals alone; their number is bounded by ``MOST_BLOCKS``.

Zero vectors have cosine 0 with everything and stand in a block of their own.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askwell.session import materialize

# the kernels travel to the workers by value: they need numpy and pyarrow there, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: reference points, and rows of the sample that they are drawn from
REFERENCES, SAMPLE = 16, 2_048
#: rings of a cell at most
RINGS = 64
MOST_BLOCKS = REFERENCES * RINGS + 1
#: rows of a block: a sixteenth of the table within these limits
LEAST_ROWS, MOST_ROWS = 128, 4_096
#: queries that one task of a top-k join holds, and rows multiplied at once
QUERY_CHUNK, AT_ONCE = 8_192, 2_048
#: room for rounding, in cosines and in angles
SLACK = 1e-6
SIM_DIGITS = 6

SIGNED = "id long, sig binary, tail binary, tail_w binary"


# --- arrays in and out of Arrow ------------------------------------------------------


def _cells(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column, and where each value starts and ends."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, n + 1, column.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def _matrix(column) -> np.ndarray:
    data, at = _cells(column)
    n = len(at) - 1
    return data[at[0] : at[-1]].view(np.float64).reshape(n, -1) if n and at[-1] > at[0] else np.zeros((n, 0))


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


class _Side:
    """The rows of one side of a block pair."""

    def __init__(self, table: pa.Table):
        self.id = table.column("id").to_numpy()
        self.sig = _matrix(table.column("sig"))
        data, at = _cells(table.column("tail"))
        self.terms = data[at[0] : at[-1]].view(np.int64)
        self.start = (at - at[0]) // 8
        weights, wat = _cells(table.column("tail_w"))
        self.weights = weights[wat[0] : wat[-1]].view(np.float64)

    def __len__(self) -> int:
        return len(self.id)

    def tails(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms and weights of some rows one after another, and where each row ends."""
        counts = self.start[rows + 1] - self.start[rows]
        ends = np.cumsum(counts)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[rows] - (ends - counts), counts)
        return self.terms[at], self.weights[at], ends


def exact_cosines(left: _Side, i: int, right: _Side, rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Cosines of row ``i`` with some rows, from their products of signatures."""
    if not len(left.terms) and not len(right.terms):
        return upper
    mine = left.terms[left.start[i] : left.start[i + 1]]
    heads = upper - left.sig[i, -1] * right.sig[rows, -1]
    if not len(mine):
        return heads
    terms, weights, ends = right.tails(rows)
    at = np.minimum(np.searchsorted(mine, terms), len(mine) - 1)
    shared = np.where(mine[at] == terms, left.weights[left.start[i] : left.start[i + 1]][at] * weights, 0.0)
    sums = np.concatenate([[0.0], np.cumsum(shared)])[np.concatenate([[0], ends])]
    return heads + np.diff(sums)


# --- signatures ------------------------------------------------------------------------


def vector_signatures(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Dense vectors scaled to length 1; null vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            norm = np.linalg.norm(v, axis=1, keepdims=True)
            unit = np.where(norm > 0, v / np.where(norm > 0, norm, 1.0), 0.0)
            none = _binary([b""] * len(v))
            yield pa.RecordBatch.from_arrays([b.column(0), _binary([u.tobytes() for u in unit]), none, none], ["id", "sig", "tail", "tail_w"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.filter(F.col("vec").isNotNull()).mapInArrow(run, SIGNED)


def text_signatures(texts: DataFrame, head: np.ndarray, allowed: np.ndarray | None = None) -> DataFrame:
    """Texts as term ids (``id, terms array<long>``): weights tf / norm, those of
    ``head`` (sorted ids) in the signature, the others in the tail, or of them only
    ``allowed`` ones (sorted ids); the norm is that of all."""
    width = len(head) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, at = b.column(1).flatten().to_numpy(zero_copy_only=False), b.column(1).offsets.to_numpy()
            at = at - at[0] if len(at) else at
            sig, tail, tail_w = [], [], []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                t, tf = np.unique(terms[s:e], return_counts=True)
                w = tf / math.sqrt(float((tf * tf).sum()))
                x = np.zeros(width)
                where = np.minimum(np.searchsorted(head, t), width - 2) if width > 1 else np.zeros(len(t), np.int64)
                inside = head[where] == t if width > 1 else np.zeros(len(t), bool)
                x[where[inside]] = w[inside]
                rest = w[~inside]
                x[-1] = math.sqrt(float((rest * rest).sum()))
                sig.append(x.tobytes())
                others = t[~inside].astype(np.int64)
                if allowed is not None:
                    known = np.searchsorted(allowed, others, "right") > np.searchsorted(allowed, others)
                    others, rest = others[known], rest[known]
                tail.append(others.tobytes())
                tail_w.append(rest.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(sig), _binary(tail), _binary(tail_w)], ["id", "sig", "tail", "tail_w"])

    return texts.mapInArrow(run, SIGNED)


# --- blocks ------------------------------------------------------------------------------


def angles(sig: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(sig @ points.T, -1.0, 1.0))


@dataclass
class Blocks:
    """What the driver knows of a placed table."""

    points: np.ndarray  # reference points (m, dims)
    rings: list[list[float]]  # inner borders of each cell's rings
    block_rows: int
    low: np.ndarray  # (blocks, m) least angles to the points
    high: np.ndarray  # (blocks, m) greatest
    rows: np.ndarray  # (blocks,)
    least_id: np.ndarray  # (blocks,)

    @property
    def units(self) -> np.ndarray:
        """Units that each block is dealt into."""
        return np.maximum(1, -(-self.rows // (2 * self.block_rows)))

    @property
    def first_unit(self) -> np.ndarray:
        return np.cumsum(self.units) - self.units

    @property
    def of_zeros(self) -> int:
        return sum(len(r) + 1 for r in self.rings)

    def block_of(self, sig: np.ndarray) -> np.ndarray:
        """Block of each row: cells one after another, in each its rings."""
        base = np.cumsum([0, *(len(r) + 1 for r in self.rings)])
        zero = ~sig.any(axis=1) if sig.shape[1] else np.ones(len(sig), bool)
        if not len(self.points):
            return np.where(zero, self.of_zeros, 0)
        d = angles(sig, self.points)
        cell = d.argmin(1)
        own = d[np.arange(len(d)), cell]
        ring = np.array([np.searchsorted(self.rings[c], x, "right") for c, x in zip(cell.tolist(), own.tolist(), strict=True)], np.int64)
        return np.where(zero, self.of_zeros, base[cell] + ring if len(cell) else 0)

    def gaps(self, low: np.ndarray, high: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """Least possible angle between rows of some intervals and each block's."""
        out = np.zeros((len(low), len(self.rows)))
        for k in range(len(self.points)):
            np.maximum(out, self.low[None, :, k] - high[:, None, k], out=out)
            np.maximum(out, low[:, None, k] - self.high[None, :, k], out=out)
        out[:, self.of_zeros :] = math.pi / 2
        out[zero] = math.pi / 2
        out[:, self.rows == 0] = np.inf
        return out


def _spread(points: np.ndarray, many: int) -> np.ndarray:
    """Some of ``points``, each as far as can be from those before."""
    chosen = [0]
    near = angles(points, points[:1])[:, 0]
    while len(chosen) < min(many, len(points)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, angles(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def place(rows: DataFrame, block_rows: int | None = None, around: Blocks | None = None) -> tuple[DataFrame, Blocks]:
    """Blocks for the rows of a stored table of signatures, and the table with
    the block of each row.  ``around`` gives the reference points of another
    table; else they are drawn from this one."""
    n = rows.count()
    size = block_rows or max(LEAST_ROWS, min(MOST_ROWS, n // 16))
    points, rings = np.zeros((0, 0)), [[]]
    if around is not None:
        if len(around.points):
            points = around.points
            rings = _rings(rows, points, size)
    elif n > size:
        # the same rows however the table is partitioned: the smallest hashes of the ids
        sample = rows.select("sig", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).select("sig").toArrow()
        sig = _matrix(sample.column("sig"))
        sig = sig[sig.any(axis=1)] if sig.shape[1] else sig[:0]
        if len(sig):
            points = _spread(sig, REFERENCES)
            rings = _rings(rows, points, size)
    blocks = Blocks(points, rings, size, *(np.zeros(0),) * 4)
    width = len(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                block = blocks.block_of(_matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(block.astype(np.int32))], ["id", "sig", "tail", "tail_w", "block"])

    placed = materialize(rows.mapInArrow(run, SIGNED + ", block int"), "placed")

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = blocks.of_zeros + 1
        low, high = np.full((count, width + 1), np.inf), np.full((count, width + 1), -np.inf)
        held, least = np.zeros(count, np.int64), np.full(count, 2**63 - 1, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            block = b.column(2).to_numpy()
            np.add.at(held, block, 1)
            np.minimum.at(least, block, b.column(0).to_numpy())
            if width:
                d = angles(_matrix(b.column(1)), points)
                np.minimum.at(low[:, :width], block, d)
                np.maximum.at(high[:, :width], block, d)
        some = np.flatnonzero(held)
        where = np.repeat(some, width + 1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(where.astype(np.int32)), pa.array(np.tile(np.arange(width + 1), len(some)).astype(np.int32)),
                pa.array(low[some].ravel()), pa.array(high[some].ravel()), pa.array(held[where]), pa.array(least[where]),
            ],
            ["block", "point", "low", "high", "n", "least_id"],
        )

    known = (
        placed.select("id", "sig", "block")
        .mapInArrow(stats, "block int, point int, low double, high double, n long, least_id long")
        .groupBy("block", "point")
        .agg(F.min("low"), F.max("high"), F.sum("n"), F.min("least_id"))
        .collect()
    )
    count = blocks.of_zeros + 1
    blocks.low, blocks.high = np.zeros((count, width)), np.zeros((count, width))
    blocks.rows, blocks.least_id = np.zeros(count, np.int64), np.full(count, 2**63 - 1, np.int64)
    for block, point, low, high, held, least in known:
        if point < width:
            blocks.low[block, point], blocks.high[block, point] = low, high
        else:
            blocks.rows[block], blocks.least_id[block] = held, least
    return placed, blocks


def _rings(rows: DataFrame, points: np.ndarray, size: int) -> list[list[float]]:
    """Borders of each cell's rings: quantiles of the angle to its point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = _matrix(b.column(0))
            d = angles(sig, points) if sig.shape[1] else np.zeros((0, len(points)))
            d = d[sig.any(axis=1)] if len(sig) else d
            yield pa.RecordBatch.from_arrays([pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], ["cell", "own"]) if len(d) else pa.RecordBatch.from_arrays(
                [pa.array([], pa.int32()), pa.array([], pa.float64())], ["cell", "own"]
            )

    grid = [k / RINGS for k in range(1, RINGS)]
    cells = (
        rows.select("sig").mapInArrow(run, "cell int, own double").groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("own", grid, 10_000).alias("q"))
        .collect()
    )
    out: list[list[float]] = [[] for _ in points]
    for r in cells:
        many = min(RINGS, -(-r["n"] // size))
        out[r["cell"]] = sorted({r["q"][k * RINGS // many - 1] for k in range(1, many)})
    return out


def _unit_column(blocks: Blocks):
    """Unit of a row: its block's first one, plus a hash of the id."""
    first = F.array(*[F.lit(int(u)) for u in blocks.first_unit])
    many = F.array(*[F.lit(int(u)) for u in blocks.units])
    return (F.element_at(first, F.col("block") + 1) + F.pmod(F.xxhash64("id"), F.element_at(many, F.col("block") + 1)).cast("int")).cast("int")


def _partners(spark: SparkSession, pairs: dict[int, list[int]], key: str, other: str) -> DataFrame:
    rows = [(u, v) for u, v in pairs.items()]
    return spark.createDataFrame(rows or [(-1, [])], f"{key} int, {other}s array<int>")


# --- threshold join ------------------------------------------------------------------------


@dataclass
class Formed:
    """How many of all unit pairs a join forms."""

    formed: int
    possible: int


def threshold_join(
    left: DataFrame, right: DataFrame | None, threshold: float, *, block_rows: int | None = None, report: list | None = None
) -> DataFrame:
    """(a, b, similarity) of all pairs whose rounded cosine reaches ``threshold``.

    Both sides are stored tables of signatures.  Without ``right``, pairs are
    within ``left`` and a < b.  ``report`` receives a ``Formed``."""
    spark = left.sparkSession
    reach = math.acos(max(-1.0, min(1.0, threshold - 2 * SLACK))) + SLACK
    alone = right is None
    l_rows, lb = place(left, block_rows)
    if alone:
        r_rows, rb = l_rows, lb
    else:
        r_rows, rb = place(right, block_rows, around=lb)
    gap = rb.gaps(lb.low, lb.high, np.arange(len(lb.rows)) >= lb.of_zeros)
    gap[lb.rows == 0] = np.inf
    near = np.argwhere(gap <= reach)
    to_right: dict[int, list[int]] = {}
    to_left: dict[int, list[int]] = {}
    formed = 0
    for i, j in near.tolist():
        for u in range(lb.first_unit[i], lb.first_unit[i] + lb.units[i]):
            for v in range(rb.first_unit[j], rb.first_unit[j] + rb.units[j]):
                if alone and v < u:
                    continue
                to_right.setdefault(int(u), []).append(int(v))
                to_left.setdefault(int(v), []).append(int(u))
                formed += 1
    if report is not None:
        a, b = int(lb.units[lb.rows > 0].sum()), int(rb.units[rb.rows > 0].sum())
        report.append(Formed(formed, a * (a + 1) // 2 if alone else a * b))
    columns = ["id", "sig", "tail", "tail_w"]
    lefts = l_rows.withColumn("u", _unit_column(lb)).join(_partners(spark, to_right, "u", "v"), "u").select("u", F.explode("vs").alias("v"), *columns)
    rights = (
        r_rows.select(*[F.col(c).alias(c) for c in r_rows.columns]).withColumn("v", _unit_column(rb))
        .join(_partners(spark, to_left, "v", "u"), "v").select(F.explode("us").alias("u"), "v", *columns)
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(key, lt: pa.Table, rt: pa.Table) -> pa.Table:
        found = [np.zeros((3, 0))]
        ids: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
        same = alone and key[0].as_py() == key[1].as_py()
        if lt.num_rows and rt.num_rows:
            x, y = _Side(lt), _Side(rt)
            for at in range(0, len(x), AT_ONCE):
                upper = x.sig[at : at + AT_ONCE] @ y.sig.T
                close = upper >= threshold - SLACK
                if same:
                    close &= x.id[at : at + AT_ONCE, None] < y.id[None, :]
                for i in np.flatnonzero(close.any(axis=1)).tolist():
                    rows = np.flatnonzero(close[i])
                    cos = exact_cosines(x, at + i, y, rows, upper[i, rows])
                    good = np.round(cos, SIM_DIGITS) >= threshold - 1e-9
                    if good.any():
                        ids.append((np.full(int(good.sum()), x.id[at + i]), y.id[rows[good]]))
                        found.append(cos[good])
        a, b = (np.concatenate([p[k] for p in ids]) for k in (0, 1))
        if alone:
            a, b = np.minimum(a, b), np.maximum(a, b)
        sim = np.concatenate([f.ravel() for f in found])
        differ = a != b if alone else np.ones(len(a), bool)
        return pa.table([pa.array(a[differ]), pa.array(b[differ]), pa.array(sim[differ])], schema=schema)

    pairs = lefts.groupBy("u", "v").cogroup(rights.groupBy("u", "v")).applyInArrow(run, "a long, b long, similarity double")
    return pairs.select("a", "b", F.round("similarity", SIM_DIGITS).alias("similarity"))


# --- join on shared hash buckets -----------------------------------------------------------

#: rows of a unit at most, and residues of bucket numbers that the driver knows of each unit
UNIT_ROWS, RESIDUES = 8_192, 64


def bucket_join(rows: DataFrame, threshold: float, *, unit_rows: int | None = None, report: list | None = None) -> DataFrame:
    """(a, b, similarity), a < b, of rows that share a bucket in some hash table and
    whose cosine reaches ``threshold``.

    ``rows`` is a stored table (id long, v array<double> of length 1, buckets
    array<long>, one for each hash table).  A bucket may hold most rows, so no
    bucket is joined with itself row by row: rows with equal buckets in the first
    tables lie in the same units, pairs of units without a common bucket in any
    table are never formed, and in a task a unit's vectors are multiplied with
    another's and pairs checked for a common bucket.  Each row goes once to each
    unit that it meets, however many buckets they share."""
    spark = rows.sparkSession
    n = rows.count()
    size = unit_rows or max(LEAST_ROWS, min(UNIT_ROWS, n // 16))
    groups = max(1, min(64, n // size))
    group = F.pmod(F.xxhash64(F.slice("buckets", 1, 3)), F.lit(groups)).cast("int")
    held = {r[0]: r[1] for r in rows.groupBy(group.alias("g")).count().collect()}
    units = np.array([-(-held.get(g, 0) // size) for g in range(groups)], np.int64)
    first = np.cumsum(units) - units
    at = F.pmod(F.xxhash64("id", F.lit(1)), F.element_at(F.array(*[F.lit(max(1, int(x))) for x in units]), group + 1))
    dealt = rows.withColumn("u", (F.element_at(F.array(*[F.lit(int(x)) for x in first]), group + 1) + at).cast("int"))
    has: dict[int, np.ndarray] = {}
    for unit, table, residues in (
        dealt.select("u", F.posexplode("buckets").alias("t", "x"))
        .groupBy("u", "t").agg(F.collect_set(F.pmod("x", F.lit(RESIDUES)).cast("int"))).collect()
    ):
        has.setdefault(unit, np.zeros((256, RESIDUES), bool))[table % 256, residues] = True
    many = sorted(has)
    meets = {u: [v for v in many if v >= u and (has[u] & has[v]).any()] for u in many}
    met_by: dict[int, list[int]] = {}
    for u, vs in meets.items():
        for v in vs:
            met_by.setdefault(v, []).append(u)
    if report is not None:
        report.append(Formed(sum(map(len, meets.values())), len(many) * (len(many) + 1) // 2))
    lefts = dealt.withColumnRenamed("v", "vec").join(_partners(spark, meets, "u", "v"), "u").select("u", F.explode("vs").alias("v"), "id", "vec", "buckets")
    rights = (
        dealt.select(F.col("u").alias("v"), F.col("id").alias("id"), F.col("v").alias("vec"), F.col("buckets").alias("buckets"))
        .join(_partners(spark, met_by, "v", "u"), "v").select(F.explode("us").alias("u"), "v", "id", "vec", "buckets")
    )
    # as far as the radius of the distance sqrt(2 - 2 cos) reaches
    least = threshold - 1e-9 * math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) - 1e-12
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def flat(table: pa.Table, name: str, kind: type) -> np.ndarray:
        column = table.column(name).combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)

    def run(lt: pa.Table, rt: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if lt.num_rows and rt.num_rows:
            same = lt.column("u")[0].as_py() == lt.column("v")[0].as_py()
            x, y = flat(lt, "vec", np.float64), flat(rt, "vec", np.float64)
            p, q = flat(lt, "buckets", np.int64), flat(rt, "buckets", np.int64)
            x_id, y_id = lt.column("id").to_numpy(), rt.column("id").to_numpy()
            for start in range(0, len(x), 1024):
                cos = x[start : start + 1024] @ y.T
                i, j = np.nonzero(cos >= least)
                sim = cos[i, j]
                i = i + start
                good = (x_id[i] < y_id[j]) if same else (x_id[i] != y_id[j])
                i, j, sim = i[good], j[good], sim[good]
                shared = np.zeros(len(i), bool)
                for k in range(p.shape[1]):
                    shared |= p[i, k] == q[j, k]
                a, b = x_id[i[shared]], y_id[j[shared]]
                found.append((np.minimum(a, b), np.maximum(a, b), sim[shared]))
        return pa.table([pa.array(np.concatenate([f[k] for f in found])) for k in range(3)], schema=schema)

    pairs = lefts.groupBy("u", "v").cogroup(rights.groupBy("u", "v")).applyInArrow(run, "a long, b long, similarity double")
    return pairs.select("a", "b", F.round("similarity", SIM_DIGITS).alias("similarity")).filter(F.col("similarity") >= threshold)


# --- top-k join ----------------------------------------------------------------------------


def topk_join(
    queries: DataFrame,
    store: DataFrame,
    k: int,
    *,
    exclude_self: bool = False,
    only_earlier: bool = False,
    positive_only: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """(q_id, s_id, sim): for each query the k most similar rows of the store, and
    what lies within 1e-6 of the k-th (the caller's ranking settles ties)."""
    s_rows, blocks = place(store, block_rows)
    units, first, m = blocks.units, blocks.first_unit, len(blocks.points)
    n_queries = queries.count()
    chunks = max(1, -(-n_queries // QUERY_CHUNK))

    def routes(part: pa.RecordBatch, floor: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, its home unit, the other units to be met) for each query."""
        sig, ids = _matrix(part.column(1)), part.column(0).to_numpy()
        zero = ~sig.any(axis=1) if sig.shape[1] else np.ones(len(ids), bool)
        d = angles(sig, blocks.points) if m else np.zeros((len(ids), 0))
        gap = blocks.gaps(d, d, zero)
        if only_earlier:
            gap[blocks.least_id[None, :] >= ids[:, None]] = np.inf
        home = gap.argmin(1)
        for i in range(len(ids)):
            h = first[home[i]] + ids[i] % units[home[i]]
            if floor is None:
                yield i, h, np.array([h] if np.isfinite(gap[i, home[i]]) else [], np.int64)
                continue
            reach = math.acos(max(-1.0, min(1.0, floor[i] - 2 * SLACK))) + SLACK
            met = np.flatnonzero(np.isfinite(gap[i]) & (gap[i] <= reach))
            every = np.concatenate([first[b] + np.arange(units[b]) for b in met] or [np.zeros(0, np.int64)])
            yield i, h, every[every != h]

    def route(with_floor: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 512):
                    part = b.slice(at, 512)
                    floor = part.column(4).to_numpy(zero_copy_only=False) if with_floor else None
                    to = [u for _, _, u in routes(part, floor)]
                    rows = pa.array(np.repeat(np.arange(len(to)), list(map(len, to))))
                    floors = part.column(4).take(rows) if with_floor else pa.array(np.full(len(rows), -2.0))
                    out = [c.take(rows) for c in part.columns[:4]]
                    unit = np.concatenate([*to, np.zeros(0, np.int64)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*out, floors, pa.array(unit)], ["id", "sig", "tail", "tail_w", "floor", "unit"])

        return run

    schema = pa.schema([("q_id", pa.int64()), ("s_id", pa.int64()), ("sim", pa.float64())])

    def best(key, qt: pa.Table, st: pa.Table) -> pa.Table:
        q_id, s_id, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if qt.num_rows and st.num_rows:
            q, s = _Side(qt), _Side(st)
            floors = qt.column("floor").to_numpy()
            for at in range(0, len(q), 256):
                uppers = q.sig[at : at + 256] @ s.sig.T
                for i in range(len(uppers)):
                    row, upper = at + i, uppers[i]
                    fits = upper >= floors[row] - SLACK
                    if exclude_self:
                        fits &= s.id != q.id[row]
                    if only_earlier:
                        fits &= s.id < q.id[row]
                    rows = np.flatnonzero(fits)
                    if not len(rows):
                        continue
                    if len(rows) > 4 * k and (len(s.terms) or len(q.terms)):
                        # the k best bounds first: what can't beat their k-th needs no exact cosine
                        top = rows[np.argpartition(-upper[rows], k - 1)[: 4 * k]]
                        cos = exact_cosines(q, row, s, top, upper[top])
                        rows = rows[upper[rows] >= np.partition(cos, -k)[-k] - SLACK]
                    cos = exact_cosines(q, row, s, rows, upper[rows])
                    if positive_only:
                        rows, cos = rows[cos > 0], cos[cos > 0]
                    if not len(rows):
                        continue
                    kth = np.partition(cos, -min(k, len(cos)))[-min(k, len(cos))]
                    good = cos >= kth - SLACK
                    q_id.append(np.full(int(good.sum()), q.id[row]))
                    s_id.append(s.id[rows[good]])
                    sims.append(cos[good])
        return pa.table([pa.array(np.concatenate(c)) for c in (q_id, s_id, sims)], schema=schema)

    routed_schema = SIGNED + ", floor double, unit int"
    stored = s_rows.withColumn("unit", _unit_column(blocks)).drop("block")
    out = "q_id long, s_id long, sim double"
    home = (
        queries.mapInArrow(route(False), routed_schema).groupBy("unit")
        .cogroup(stored.groupBy("unit")).applyInArrow(best, out)
    )
    home = materialize(home, "topk-home")
    # the k-th best at home, -2 where there are fewer than k
    kth = (
        home.withColumn("_r", F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("sim").desc(), "s_id")))
        .filter(F.col("_r") == k).select(F.col("q_id").alias("_q"), F.col("sim").alias("_s"))
    )
    with_floor = queries.join(kth, F.col("id") == F.col("_q"), "left").select("id", "sig", "tail", "tail_w", F.coalesce("_s", F.lit(-2.0)).alias("floor"))
    routed = with_floor.mapInArrow(route(True), routed_schema).withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
    again = stored.select(*[F.col(c).alias(c) for c in stored.columns], F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    others = routed.groupBy("unit", "chunk").cogroup(again.groupBy("unit", "chunk")).applyInArrow(best, out)
    return home.unionByName(others)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(q_id, rank, s_id, similarity): by rounded similarity, then by id."""
    sim = F.round("sim", SIM_DIGITS)
    order = Window.partitionBy("q_id").orderBy(sim.desc(), F.col("s_id").asc())
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("q_id", F.col("rank").cast("bigint").alias("rank"), "s_id", sim.alias("similarity"))
    )
