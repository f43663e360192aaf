"""Exact joins of texts by term cosine, in few large units of compact rows.

A text travels as its term counts: ranks of the ``RANKED`` most frequent terms
as sorted steps, 64-bit hashes of the others, all packed (about 3 bytes a term).
Rows are dealt by a hash of the id into units; each pair of units is one task, and
the number of units follows the cores, and the bytes only where a unit would
outgrow a task.  So a row is sent to about as many tasks however many rows there
are, and what a task holds is bounded.

In a task:

* A row has a place: its coordinates on the main axes of the frequent terms' weights, and
  the norm of all that is left.  By Cauchy and Schwarz a product of places is never below
  the cosine.  Rows near one another are blocks, and blocks whose boxes lie too far apart
  are left out; the places of two blocks are multiplied.  Between units, this is done
  with stored places first, and only rows that may have a partner are unpacked.
* Rows of two blocks that may still reach the threshold have signatures: the weights of the
  first ``direct`` ranks (a part of them first) with the norm of the other terms, and then
  the norms of as many buckets of these.  Products of signatures are never below the cosine either; the part of
  the ranks alone is never above it (weights are not negative).  Where many pairs are left,
  this is done again with ``FINER`` times as many components.
* The cosine of what is left is taken from all terms, as an integer product of counts.

Joins that ask for the best partner of each row keep the best lower bound so far and
pass over pairs that can't beat it; they return one row per row and task, so that
texts that all lie close together (long texts of one language do) aren't listed pair
by pair.

Within one set, such a join (``later``) first deals the rows into units of texts near one
another, which are compared in themselves and stored with the best partners found.  Units
too far apart never meet.  The other pairs of units are compared in rounds, which begin
with what was found before; a round deals out a few times the stored bytes, and its
shuffle files go at its end.  So the disk it takes grows with the input, not with the
number of units.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.session import shuffles_released, stored

# the kernels travel to the workers by value: they need numpy and pyarrow there, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: terms that travel as ranks, at most
RANKED = 131_072
#: packed bytes of a unit that a task holds, at most; tasks for each core, at least
UNIT_BYTES, TASKS = 24_000_000, 2
#: of a join in rounds: bytes that a row's place counts for, tasks for each core, rows drawn
#: at least and for each unit, bytes dealt out at once (times those stored, and at least)
PLACE_BYTES, NEAR_TASKS, SEEN, SEEN_OF_UNIT, COPIES, LEAST_DEALT = 200, 8, 4_096, 256, 2, 64_000_000
#: ranks that axes are made of, axes, those of stored places, and rows of a unit pair that axes are drawn from
FIELD, AXES, STORED_AXES, DRAWN = 1_024, 48, 24, 1_024
#: rows of a block, blocks of one side that are met in turn, pairs whose terms are compared at once
BLOCK, HELD, WAITING = 512, 16, 8_192
#: share of the direct ranks that are multiplied first
FEW = 0.25
#: share of a block pair's pairs from which a finer product is made, and how much finer
MANY, FINER = 0.01, 8
#: room for rounding of products in single precision
SLACK = 1e-5
SIM_DIGITS = 6

CODED = "id long, code binary"
PAIRS, LATER, RIGHT = "pairs", "later", "right"


# --- rows -------------------------------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    """Integers byte by byte, the highest bytes together: these are mostly zero."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _from_planes(data: bytes, at: int, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T.copy().view(np.int32).reshape(n)


def pack(terms: np.ndarray, ranked: np.ndarray, rank: np.ndarray) -> bytes:
    """Term hashes of a text, each as often as it occurs; ``ranked`` are sorted
    hashes and ``rank`` their ranks."""
    t, tf = np.unique(terms, return_counts=True)
    # terms without a rank come last, in the order of their hashes
    r = np.full(len(t), np.iinfo(np.int32).max, np.int32)
    if len(ranked):
        where = np.searchsorted(ranked[:-1], t)
        np.copyto(r, rank[where], where=ranked[where] == t)
    order = r.argsort(kind="stable")
    r = r[order]
    n = int(r.searchsorted(np.iinfo(np.int32).max))
    steps = r[:n].copy()
    steps[1:] -= r[: max(n - 1, 0)]
    data = _planes(steps) + _planes(tf[order].astype(np.int32)) + t[order[n:]].astype(np.int64).tobytes()
    return np.array([n, len(t) - n], np.int32).tobytes() + zlib.compress(data, 1)


def unpack(code: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks, hashes of the other terms, and the counts of both in this order."""
    n, m = np.frombuffer(code, np.int32, 2).tolist()
    data = zlib.decompress(memoryview(code)[8:])
    ranks = np.cumsum(_from_planes(data, 0, n), dtype=np.int32)
    return ranks, np.frombuffer(data, np.int64, m, 4 * n + 4 * (n + m)), _from_planes(data, 4 * n, n + m)


def packed(texts: DataFrame, ranked: np.ndarray) -> DataFrame:
    """``texts`` (terms array<long> last) with ``code`` in its place; ``ranked``:
    hashes of the ranked terms, the most frequent first."""
    order = np.argsort(ranked)
    hashes, rank = ranked[order], order.astype(np.int32)
    names = texts.columns[:-1]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, at = b.column(len(names)).flatten().to_numpy(zero_copy_only=False), b.column(len(names)).offsets.to_numpy()
            at = (at - at[0]).tolist() if len(at) else [0]
            codes = [pack(terms[s:e], hashes, rank) for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(codes, pa.binary())], [*names, "code"])

    return texts.mapInArrow(run, f"{schema}, code binary")


class _Rows:
    """The rows of one unit, term counts one row after another."""

    def __init__(self, ids: np.ndarray, codes: list[bytes], best: np.ndarray | None = None):
        """``best``: the best cosine found so far, negative where there is none."""
        n = len(ids)
        self.id = ids
        self.best = np.full(n, -1.0) if best is None else best
        self.whose = np.zeros(n, np.int64)
        sizes = np.array([np.frombuffer(c, np.int32, 2) for c in codes], np.int64).reshape(n, 2)
        self.start = np.concatenate([[0], np.cumsum(sizes.sum(1))])
        self.ranked = self.start[:-1] + sizes[:, 0]
        # terms without a number yet are after all ranks
        self.term, self.tf = np.full(self.start[-1], np.iinfo(np.int32).max, np.int32), np.zeros(self.start[-1], np.float32)
        self.norm, self.hashes = np.zeros(n), np.zeros(sizes[:, 1].sum(), np.int64)
        at = 0
        codes.reverse()
        for i in range(n):
            ranks, others, counts = unpack(codes.pop())
            self.term[self.start[i] : self.ranked[i]] = ranks
            self.tf[self.start[i] : self.start[i + 1]] = counts
            self.hashes[at : at + len(others)] = others
            at += len(others)
            x = counts.astype(np.float64)
            self.norm[i] = math.sqrt(float(x @ x))

    def number(self, numbers: np.ndarray) -> None:
        """Ranks stay; the other terms get their numbers."""
        counts = self.start[1:] - self.ranked
        at = np.arange(len(self.hashes)) + np.repeat(self.ranked - (np.cumsum(counts) - counts), counts)
        self.term[at] = numbers
        self.hashes = self.hashes[:0]

    def __len__(self) -> int:
        return len(self.id)

    def postings(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of some rows' terms, and where each row begins among them."""
        counts = self.start[rows + 1] - self.start[rows]
        begins = np.cumsum(counts) - counts
        return np.arange(int(counts.sum())) + np.repeat(self.start[rows] - begins, counts), begins

    def signature(self, rows: np.ndarray, direct: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the first ranks, and the norms of the other terms' buckets."""
        at, begins = self.postings(rows)
        counts = self.start[rows + 1] - self.start[rows]
        term = self.term[at]
        w = self.tf[at] / np.repeat(self.norm[rows], counts)
        row = np.repeat(np.arange(len(rows)), counts)
        inside = term < direct
        heads = np.zeros((len(rows), direct), np.float32)
        heads[row[inside], term[inside]] = w[inside]
        row, w = row[~inside], w[~inside]
        # consecutive numbers spread over all buckets
        bucket = (term[~inside].astype(np.uint32) * np.uint32(2_654_435_761) >> np.uint32(16)) * np.uint32(buckets) >> np.uint32(16)
        rest = np.zeros(len(rows) * buckets, np.float32)
        np.add.at(rest, row * buckets + bucket, (w * w).astype(np.float32))
        return heads, np.sqrt(rest, out=rest).reshape(len(rows), buckets)


    def weights(self, rows: np.ndarray, field: int) -> np.ndarray:
        at, _ = self.postings(rows)
        row = np.repeat(np.arange(len(rows)), self.start[rows + 1] - self.start[rows])
        inside = self.term[at] < field
        row, at = row[inside], at[inside]
        out = np.zeros((len(rows), field))
        out[row, self.term[at]] = self.tf[at] / self.norm[rows][row]
        return out

    def drawn(self, field: int) -> np.ndarray:
        return self.weights(np.unique(np.linspace(0, len(self) - 1, DRAWN).astype(np.int64)), field)

    def places(self, axes: np.ndarray) -> np.ndarray:
        """Coordinates on the axes, and the norm of the rest, which rounding may only raise."""
        out = np.zeros((len(self), axes.shape[1] + 1), np.float32)
        for at in range(0, len(self), BLOCK):
            some = np.arange(at, min(len(self), at + BLOCK))
            out[some] = _places(self.weights(some, len(axes)), axes)
        return out


def _places(weights: np.ndarray, axes: np.ndarray) -> np.ndarray:
    on = weights @ axes
    return np.hstack([on, np.sqrt(np.maximum(0.0, 1.0 - (on * on).sum(1, keepdims=True)) + 1e-10)]).astype(np.float32)


def _axes(drawn: np.ndarray) -> np.ndarray:
    """Orthonormal axes on which rows (dense weights) have most of their length.  Any
    such axes give true bounds."""
    field = drawn.shape[1]
    tried = min(AXES + 8, field)
    if not tried:
        return np.zeros((field, 0))
    axes = np.random.default_rng(0).normal(size=(field, tried))
    for _ in range(3):
        axes = drawn.T @ (drawn @ np.linalg.qr(axes)[0])
    axes = np.linalg.qr(axes)[0]
    return axes @ np.linalg.svd(drawn @ axes, full_matrices=False)[2].T[:, :AXES]


def _gaps(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squared distances of a box from others."""
    return (np.maximum(np.maximum(lows - high, low - highs), 0.0) ** 2).sum(1)


def _reach(cosine: float) -> float:
    """Squared distance of places from which the cosine can't be reached."""
    return 2.0 - 2.0 * cosine + 1e-4


class _Blocks:
    """Blocks of rows near one another, and the boxes that their places fill."""

    def __init__(self, place: np.ndarray):
        self.place = place
        self.rows, todo = [], [np.arange(len(place))]
        while todo:
            some = todo.pop()
            if len(some) <= BLOCK:
                self.rows.append(some)
                continue
            at = self.place[some]
            half = -(-len(some) // BLOCK) // 2 * BLOCK
            order = np.argpartition(at[:, int(at.var(0).argmax())], half)
            todo += [some[order[half:]], some[order[:half]]]
        self.low = np.array([self.place[r].min(0) for r in self.rows])
        self.high = np.array([self.place[r].max(0) for r in self.rows])


def _meeting(x: np.ndarray, y: np.ndarray, least_x: np.ndarray, least_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two units, told by their places, that a row of the other may be near
    enough; each row has the least cosine that counts for it."""
    xb, yb = _Blocks(x), _Blocks(y)
    keep, keep_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
    for xr, low, high in zip(xb.rows, xb.low, xb.high, strict=True):
        least = least_x[xr].min()
        for q in np.argsort(gaps := _gaps(low, high, yb.low, yb.high), kind="stable"):
            yr = yb.rows[q]
            lowest = min(least, least_y[yr].min())
            if gaps[q] > _reach(lowest) or (keep[xr].all() and keep_y[yr].all()):
                continue
            # what is to be known: of those not kept yet, whether any of the others is near
            some, others = xr[~keep[xr]], yr[~keep_y[yr]]
            near = x[some] @ y[yr].T >= lowest
            keep[some], keep_y[yr] = near.any(1), keep_y[yr] | near.any(0)
            others = others[~keep_y[others]]
            kept = xr[keep[xr]]
            keep_y[others] = (y[others] @ x[kept].T >= lowest).any(1)
    return np.flatnonzero(keep), np.flatnonzero(keep_y)


def _products(u: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """u[i] times v[j]; a whole product takes about a fortieth of the time for a pair."""
    some, others = np.zeros(len(u), bool), np.zeros(len(v), bool)
    some[i], others[j] = True, True
    if 40 * len(i) < int(some.sum()) * int(others.sum()):
        return np.einsum("ij,ij->i", u[i], v[j])
    return (u[some] @ v[others].T)[(np.cumsum(some) - 1)[i], (np.cumsum(others) - 1)[j]]


# --- a pair of units ------------------------------------------------------------------------------


def join_units(x: _Rows, y: _Rows | None, ranks: int, threshold: float, mode: str, direct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cosine) of rows of two units, or of one with itself.  ``pairs``: all
    pairs that reach the threshold; ``later``: for each row the best one of smaller id,
    ``right``: for each row of ``y`` the best one; these have the partner's id as a, and
    are left out if not above what the row had as its best, which they replace there."""
    alone = y is None
    sides = [x] if alone else [x, y]
    known, numbers = np.unique(np.concatenate([s.hashes for s in sides]), return_inverse=True)
    for s in sides:
        mine, numbers = np.split(numbers, [len(s.hashes)])
        s.number(ranks + mine)
    y = x if alone else y
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(x) or not len(y):
        return none
    axes = _axes(np.vstack([s.drawn(min(ranks, FIELD)) for s in sides]))
    xb = _Blocks(x.places(axes))
    yb = xb if alone else _Blocks(y.places(axes))
    # for each row as the one that looks for a partner: lower bound, best cosine, whose
    least = threshold - 2 * SLACK
    floor = {id(s): np.maximum(s.best - 2 * SLACK, least).astype(np.float32) for s in sides}
    best = {id(s): s.best.copy() for s in sides}
    whose = {id(s): np.zeros(len(s), np.int64) for s in sides}
    fx, fy = floor[id(x)], floor[id(y)]
    column = np.zeros(ranks + len(known))
    found, waiting = [none], []

    def ahead(i, j):
        return np.ones(len(i), bool) if mode == RIGHT else x.id[i] < y.id[j]

    def may_count(i, j, first, upper):
        return upper >= (least if mode == PAIRS else np.where(first, fy[j], fx[i]))

    def raise_floors(i, j, first, low):
        if mode == PAIRS:
            return
        more = may_count(i, j, first, low)
        i, j, first, low = i[more], j[more], first[more], low[more]
        np.maximum.at(fy, j[first], low[first])
        np.maximum.at(fx, i[~first], low[~first])

    def cosines(i, j):
        swap = len(np.unique(i)) > len(np.unique(j))
        (u, one), (v, other) = ((y, j), (x, i)) if swap else ((x, i), (y, j))
        order = np.argsort(one, kind="stable")
        one, other = one[order], other[order]
        dots = np.zeros(len(one))
        first = np.flatnonzero(np.diff(one, prepend=-1)).tolist()
        for s, e in zip(first, [*first[1:], len(one)], strict=True):
            mine = slice(u.start[one[s]], u.start[one[s] + 1])
            column[u.term[mine]] = u.tf[mine]
            at, begins = v.postings(other[s:e])
            dots[s:e] = np.add.reduceat(column[v.term[at]] * v.tf[at], begins)
            column[u.term[mine]] = 0.0
        cos = np.empty(len(one))
        cos[order] = dots / (u.norm[one] * v.norm[other])
        return cos

    def compare_terms():
        """Of the pairs that wait, those whose cosine counts; each row's likeliest partner
        is compared first, which rules out most of its others."""
        i, j, upper = (np.concatenate([w[k] for w in waiting]) for k in range(3))
        waiting.clear()
        first = ahead(i, j)
        if mode != PAIRS:
            order = np.argsort(-upper, kind="stable")
            seeker = np.where(first, j, i if alone else len(y) + i)
            likely = np.zeros(len(i), bool)
            likely[order[np.unique(seeker[order], return_index=True)[1]]] = True
            likely &= may_count(i, j, first, upper)
            count(i[likely], j[likely], first[likely])
            i, j, first, upper = i[~likely], j[~likely], first[~likely], upper[~likely]
        keep = may_count(i, j, first, upper)
        count(i[keep], j[keep], first[keep])

    def count(i, j, first):
        if not len(i):
            return
        cos = cosines(i, j)
        good = np.round(cos, SIM_DIGITS) >= threshold - 1e-9
        i, j, first, cos = i[good], j[good], first[good], cos[good]
        if mode == PAIRS:
            found.append((x.id[i], y.id[j], cos))
            return
        raise_floors(i, j, first, cos - 2 * SLACK)
        for s, where, row, of in ((y, first, j, x.id[i]), (x, ~first, i, y.id[j])):
            row, of, c = row[where], of[where], cos[where]
            # each row's greatest comes last, and is what stays
            order = np.argsort(c, kind="stable")
            row, of, c = row[order], of[order], c[order]
            better = c > best[id(s)][row]
            best[id(s)][row[better]], whose[id(s)][row[better]] = c[better], of[better]

    gaps = np.array([_gaps(low, high, yb.low, yb.high) for low, high in zip(xb.low, xb.high, strict=True)])
    if alone:
        gaps[np.tril_indices(len(gaps), -1)] = np.inf
    # the nearest blocks first, so that bounds are high for the others; between units, they come from before
    early = np.zeros(gaps.shape, bool)
    if mode == RIGHT or mode == LATER and alone:
        np.put_along_axis(early, np.argsort(gaps, axis=1, kind="stable")[:, :3], True, axis=1)
    meet = gaps <= _reach(least)
    met = [(p, q) for some in (early & meet, ~early & meet) for at in range(0, len(xb.rows), HELD)
           for q, p in np.argwhere(some[at : at + HELD].T) + [0, at]]
    few = int(FEW * direct)
    signatures: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def signature(s, rows, k):
        key = id(s), k
        if key in signatures:
            signatures[key] = signatures.pop(key)
        else:
            while len(signatures) > HELD + 1:
                del signatures[next(iter(signatures))]
            heads, rest = s.signature(rows, direct, direct)
            tail = (rest * rest).sum(1, keepdims=True)
            begin = np.hstack([heads[:, :few], np.sqrt(tail + (heads[:, few:] ** 2).sum(1, keepdims=True))])
            signatures[key] = begin, np.hstack([heads, np.sqrt(tail)]), rest
        return signatures[key]

    finer: dict[int, tuple[int, tuple[np.ndarray, np.ndarray]]] = {}

    def finer_signature(side, rows, k, some):
        s = (x, y)[side]
        if 2 * len(some) < len(rows):
            return s.signature(rows[some], direct * FINER, direct * FINER)
        if side not in finer or finer[side][0] != k:
            finer[side] = k, s.signature(rows, direct * FINER, direct * FINER)
        heads, rest = finer[side][1]
        return (heads, rest) if len(some) == len(rows) else (heads[some], rest[some])

    for p, q in met:
        xr, yr = xb.rows[p], yb.rows[q]
        lowest = least if mode == PAIRS else fy[yr].min() if mode == RIGHT else min(fx[xr].min(), fy[yr].min())
        if gaps[p, q] > _reach(lowest):
            continue
        near = xb.place[xr] @ yb.place[yr].T >= lowest
        if alone and p == q:
            near &= np.triu(np.ones(near.shape, bool), 1)
        some, others = near.any(1).nonzero()[0], near.any(0).nonzero()[0]
        if not len(some):
            continue
        (xf, xh, xt), (yf, yh, yt) = signature(x, xr, p), signature(y, yr, q)
        near = xf[some] @ yf[others].T >= lowest
        some, others = some[near.any(1)], others[near.any(0)]
        if not len(some):
            continue
        upper = xh[some] @ yh[others].T
        if alone and p == q:
            upper[some[:, None] >= others] = -1.0
        at = np.flatnonzero(upper >= lowest)
        i, j = np.divmod(at, len(others))
        upper, i, j = upper.ravel()[at], some[i], others[j]
        one, other = x.id[xr][i], y.id[yr][j]
        if mode != RIGHT and (same := one == other).any():
            upper, i, j, one, other = upper[~same], i[~same], j[~same], one[~same], other[~same]
        low, first = upper - xh[:, -1][i] * yh[:, -1][j], np.ones(len(i), bool) if mode == RIGHT else one < other
        if mode == PAIRS:
            keep = upper >= least
        else:
            more = low - 2 * SLACK > np.where(first, fy[yr][j], fx[xr][i])
            raise_floors(xr[i[more]], yr[j[more]], first[more], low[more] - 2 * SLACK)
            keep = upper >= np.where(first, fy[yr][j], fx[xr][i])
        i, j, first, low = i[keep], j[keep], first[keep], low[keep]
        if not len(i):
            continue
        upper = low + _products(xt, yt, i, j)
        keep = may_count(xr[i], yr[j], first, upper)
        i, j, first, upper = i[keep], j[keep], first[keep], upper[keep]
        some, i_ = np.unique(i, return_inverse=True)
        others, j_ = np.unique(j, return_inverse=True)
        if len(i) > MANY * len(some) * len(others) + 16:
            # the same with more components, for the rows that still have pairs
            (xh, xt), (yh, yt) = finer_signature(0, xr, p, some), finer_signature(1, yr, q, others)
            low = (xh @ yh.T)[i_, j_]
            raise_floors(xr[i], yr[j], first, low - 2 * SLACK)
            upper = low + (xt @ yt.T)[i_, j_]
            keep = may_count(xr[i], yr[j], first, upper)
            i, j, upper = i[keep], j[keep], upper[keep]
        if len(i):
            waiting.append((xr[i], yr[j], upper))
            if sum(len(w[0]) for w in waiting) >= WAITING:
                compare_terms()
    if waiting:
        compare_terms()
    if mode != PAIRS:
        for s in sides:
            has = best[id(s)] > s.best
            found.append((whose[id(s)][has], s.id[has], best[id(s)][has]))
            s.best, s.whose = best[id(s)], whose[id(s)]
    a, b, cos = (np.concatenate([f[k] for f in found]) for k in range(3))
    if mode == PAIRS and alone:
        a, b = np.minimum(a, b), np.maximum(a, b)
    return a, b, cos


# --- joins ----------------------------------------------------------------------------------------


def _units(rows: DataFrame, unit_rows: int | None, more: int = 0) -> tuple[int, int]:
    """Rows, and units that they need at least; a row takes ``more`` bytes than its code."""
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("code") + more), F.lit(0))).first()
    return n, max(1, -(-n // unit_rows) if unit_rows else -(-size // UNIT_BYTES))


def _tree(place: np.ndarray, size: np.ndarray, most: float, first: int = 0) -> tuple[tuple, int]:
    """Cuts places into units of about the size ``most``: (axis, cut, below, above), and
    where no cut is left (first unit, number of units); also the number of the next unit."""
    many = max(1, math.ceil(size.sum() / most - 0.1))
    if many == 1:
        return (first, 1), first + 1
    for axis in np.argsort(-place.var(0), kind="stable"):
        at = place[:, axis]
        order = np.argsort(at, kind="stable")
        sums = np.cumsum(size[order])
        cut = at[order[np.searchsorted(sums, sums[-1] * (many // 2) / many)]]
        below = at < cut
        if not below.any():  # many are equal
            below = at <= cut
            if below.all():
                continue
            cut = at[~below].min()
        lower, then = _tree(place[below], size[below], most, first)
        upper, then = _tree(place[~below], size[~below], most, then)
        return (int(axis), float(cut), lower, upper), then
    return (first, many), first + many


def _unit_of(tree: tuple, place: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Units of rows; ``spread`` deals them out where there is no cut."""
    if len(tree) == 2:
        return tree[0] + spread % tree[1]
    axis, cut, lower, upper = tree
    below = place[:, axis] < cut
    out = np.zeros(len(place), np.int64)
    out[below], out[~below] = _unit_of(lower, place[below], spread[below]), _unit_of(upper, place[~below], spread[~below])
    return out


def _gathered(batches: Iterator[pa.RecordBatch], key: str, names: list[str]) -> dict[int, list[list]]:
    """Columns of a task's rows as lists, by the number in ``key``."""
    held: dict[int, list[list]] = {}
    for b in batches:
        columns = [b.column(c).to_pylist() for c in names]
        for k, row in zip(b.column(key).to_pylist(), zip(*columns, strict=True), strict=True):
            for of, v in zip(held.setdefault(k, [[] for _ in names]), row, strict=True):
                of.append(v)
    return held


def _settled_units(rows: DataFrame, ranks: int, threshold: float, direct: int, unit_rows: int | None) -> DataFrame:
    """Stored rows (unit, id, code, best, whose, place) in units of texts near one another, with the
    best earlier partners of the same unit; the first row of a unit has its ``box``."""
    n, many = _units(rows, unit_rows, PLACE_BYTES)
    if unit_rows is None:
        many = max(many, min(math.ceil(math.sqrt(2 * NEAR_TASKS * rows.sparkSession.sparkContext.defaultParallelism)), n // 256))
    field = min(ranks, FIELD)

    def drawn(most: int) -> DataFrame:
        some = rows.filter(F.pmod(F.xxhash64("id", "code"), F.lit(1 << 30)) < int(most / n * (1 << 30))) if n > most else rows
        return some.select("id", "code")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _Rows(b.column(0).to_numpy(), b.column(1).to_pylist())
            weights = [x.weights(np.array([k]), field).astype(np.float32).tobytes() for k in range(len(x))]
            yield pa.RecordBatch.from_arrays([pa.array(weights, pa.binary())], ["weights"])

    weights = drawn(2 * DRAWN).mapInArrow(weigh, "weights binary").toArrow().column(0).to_pylist()
    axes = _axes(np.frombuffer(b"".join(weights), np.float32).reshape(len(weights), field).astype(np.float64))[:, :STORED_AXES]

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(1).to_pylist()
            size = [1 if unit_rows else len(c) + PLACE_BYTES for c in codes]
            places = [p.tobytes() for p in _Rows(b.column(0).to_numpy(), codes).places(axes)]
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()), pa.array(places, pa.binary())], ["size", "place"])

    located = drawn(max(SEEN, SEEN_OF_UNIT * many)).mapInArrow(locate, "size long, place binary").toArrow()
    size = located.column("size").to_numpy().astype(np.float64)
    places = np.frombuffer(b"".join(located.column("place").to_pylist()), np.float32).reshape(len(size), axes.shape[1] + 1)
    tree, many = _tree(places, size, max(size.sum(), 1.0) / many)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, codes = b.column(0).to_numpy(), b.column(1).to_pylist()
            spread = np.array([zlib.crc32(c, i & 0xFFFFFFFF) for i, c in zip(ids.tolist(), codes, strict=True)], np.int64)
            unit = _unit_of(tree, _Rows(ids, codes).places(axes), spread)
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int32()), b.column(0), b.column(1)], ["unit", "id", "code"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _gathered(batches, "unit", ["id", "code"])
        for unit in list(held):
            ids, codes = held.pop(unit)
            ids = np.array(ids, np.int64)
            x = _Rows(ids, list(codes))
            places = x.places(axes)
            box = np.concatenate([places.min(0), places.max(0)]).tobytes()
            join_units(x, None, ranks, threshold, LATER, direct)
            for at in range(0, len(ids), 4 * BLOCK):
                part = slice(at, at + 4 * BLOCK)
                m = len(ids[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, unit, np.int32)), pa.array(ids[part]), pa.array(codes[part], pa.binary()), pa.array(x.best[part]),
                     pa.array(x.whose[part]), pa.array([p.tobytes() for p in places[part]], pa.binary()), pa.array([None if at else box, *[None] * (m - 1)], pa.binary())],
                    ["unit", "id", "code", "best", "whose", "place", "box"],
                )

    placed = rows.select("id", "code").mapInArrow(place, "unit int, id long, code binary").repartitionById(many, F.col("unit"))
    return stored(placed.mapInArrow(settle, "unit int, id long, code binary, best double, whose long, place binary, box binary"), "text-units")[0]


def _rounds(units: DataFrame, threshold: float) -> list[list[tuple[int, int]]]:
    """Pairs of units that are near enough, the nearest first, as many at once as may be dealt out."""
    size = {r["unit"]: r["size"] for r in units.groupBy("unit").agg(F.sum(F.length("code") + PLACE_BYTES).alias("size")).collect()}
    boxes = {r["unit"]: np.frombuffer(r["box"], np.float32).reshape(2, -1) for r in units.filter(F.col("box").isNotNull()).select("unit", "box").collect()}
    names = np.array(sorted(boxes), np.int64)
    lows, highs = (np.array([boxes[u][k] for u in names.tolist()]) for k in range(2))
    near = []
    for k, u in enumerate(names.tolist()):
        gaps = _gaps(*boxes[u], lows[k + 1 :], highs[k + 1 :])
        near += [(gaps[i], u, int(names[k + 1 + i])) for i in np.flatnonzero(gaps <= _reach(threshold - 2 * SLACK))]
    most, dealt, rounds = max(LEAST_DEALT, COPIES * sum(size.values())), 0, []
    for _, u, v in sorted(near):
        dealt += size[u] + size[v]
        if not rounds or dealt > most:
            rounds.append([])
            dealt = size[u] + size[v]
        rounds[-1].append((u, v))
    return rounds


def _best_earlier(rows: DataFrame, ranks: int, threshold: float, direct: int, unit_rows: int | None) -> DataFrame:
    """The join in the mode ``later``, run here in rounds."""
    spark = rows.sparkSession
    columns = "a long, b long, similarity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _gathered(batches, "side", ["id", "code", "best", "place"])
        for pair in sorted({k // 2 for k in held if k % 2}):
            sides = [held.pop(2 * pair + k) for k in range(2)]
            places = [np.frombuffer(b"".join(place), np.float32).reshape(len(place), -1) for *_, place in sides]
            best = [np.array(b) for _, _, b, _ in sides]
            # only rows that may have a partner there are unpacked
            some = _meeting(*places, *(np.maximum(b, threshold) - 2 * SLACK for b in best))
            del places
            x, y = (_Rows(np.array(i, np.int64)[k], [c[at] for at in k.tolist()], b[k]) for (i, c, *_), b, k in zip(sides, best, some, strict=True))
            del sides
            a, b, cos = join_units(x, y, ranks, threshold, LATER, direct)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, cos)], ["a", "b", "similarity"])

    with shuffles_released(spark):
        units = _settled_units(rows, ranks, threshold, direct, unit_rows)
        found = [units.filter(F.col("best") >= 0).select(F.col("whose").alias("a"), F.col("id").alias("b"), F.col("best").alias("similarity"))]
        for pairs in _rounds(units, threshold):
            meets = [(u, 2 * k + side) for k, pair in enumerate(pairs) for side, u in enumerate(pair)]
            meets = spark.createDataFrame(pa.table({"unit": pa.array([u for u, _ in meets], pa.int32()), "side": pa.array([s for _, s in meets], pa.int32())}))
            dealt = units.join(F.broadcast(meets), "unit").select(F.expr("cast(side div 2 as int)").alias("pair"), "side", "id", "code", "best", "place")
            placed = dealt.repartitionById(len(pairs), F.col("pair"))
            found.append(stored(placed.mapInArrow(run, columns), "text-round")[0])
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def join(
    left: DataFrame, right: DataFrame | None, ranks: int, threshold: float, *, mode: str = PAIRS, direct: int = 512, unit_rows: int | None = None
) -> DataFrame:
    """(a, b, similarity) of texts whose rounded cosine reaches ``threshold``.

    Both sides are stored tables (id, code) over the same ``ranks`` ranked terms.
    Without ``right``, pairs are within ``left`` and a < b.  In the modes ``later``
    (within ``left``, run here and now) and ``right``, a row b comes once from each task
    that found a partner a, with its best one there; the best of all is among them."""
    if mode == LATER:
        found = _best_earlier(left, ranks, threshold, direct, unit_rows)
        return found.select("a", "b", F.round("similarity", SIM_DIGITS).alias("similarity"))
    tasks = TASKS * left.sparkSession.sparkContext.defaultParallelism
    n, many = _units(left, unit_rows)
    alone = right is None
    if alone:
        if unit_rows is None:
            many = max(many, min(math.ceil(math.sqrt(2 * tasks)), n // 256))
        sides = [left.select("id", "code", F.pmod(F.xxhash64("id"), F.lit(many)).alias("u"), F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("v"))]
        a, b = F.least("u", "v"), F.greatest("u", "v")
        pair = a * many - (a * (a - 1) / 2).cast("long") + b - a
        pairs = many * (many + 1) // 2
        # a row is on the left with units after its own and on the right with those before
        dealt = sides[0].select(pair.cast("int").alias("pair"), (F.col("v") < F.col("u")).alias("second"), (a == b).alias("alone"), "id", "code")
    else:
        m, others = _units(right, unit_rows)
        if unit_rows is None:
            # the larger side is dealt out further: each of its rows is sent to the other's units
            if n > m:
                many = max(many, min(-(-tasks // others), n // 256))
            else:
                others = max(others, min(-(-tasks // many), m // 256))
        pairs = many * others
        u, v = F.pmod(F.xxhash64("id"), F.lit(many)), F.pmod(F.xxhash64("id"), F.lit(others))

        def side(rows, own, count, second):
            met = rows.select("id", "code", own.alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("_met"))
            x, y = ("_met", "_own") if second else ("_own", "_met")
            return met.select((F.col(x) * others + F.col(y)).cast("int").alias("pair"), F.lit(second).alias("second"), F.lit(False).alias("alone"), "id", "code")

        dealt = side(left, u, others, False).unionAll(side(right, v, many, True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[bool, list, list]] = {}
        for b in batches:
            second = b.column(1).to_numpy(zero_copy_only=False)
            ids, codes, both = b.column(3).to_numpy(), b.column(4).to_pylist(), b.column(2).to_numpy(zero_copy_only=False)
            for k, pair in enumerate(b.column(0).to_pylist()):
                of = held.setdefault(pair, (bool(both[k]), ([], []), ([], [])))[2 if second[k] else 1]
                of[0].append(ids[k])
                of[1].append(codes[k])
        for pair in list(held):
            same, *two = held.pop(pair)
            x, y = (_Rows(np.array(i, np.int64), c) for i, c in two)
            a, b, cos = join_units(x, None if same else y, ranks, threshold, mode, direct)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(cos)], ["a", "b", "similarity"])

    placed = dealt.repartitionById(pairs, F.col("pair"))
    return placed.mapInArrow(run, "a long, b long, similarity double").select("a", "b", F.round("similarity", SIM_DIGITS).alias("similarity"))
