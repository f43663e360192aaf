"""Vector code compression: each of four parts of a vector becomes the number
of the nearest entry of that part's codebook, learned in rounds.

Rounds need not look at all entries again.  The codebooks of all rounds are kept
(they are small), and a vector keeps, for each part,

* an upper bound on the distance to its own entry, and
* for each group of entries a lower bound on the distance to all others in it,

each with the round in which it was measured.  A bound of round s holds in round
r after the *net* displacement between the codebooks of s and r (the norm of the
summed moves) is added or taken off; that is never more than the norms of the
single moves added up, and an entry that comes back costs nothing.  Where the
upper bound stays below every lower bound, the part keeps its entry and its old
bounds.  Else the own distance is measured, and only the groups whose bound does
not clear it are scanned again, exactly and with ties to the lower index.  Bounds
are stored rounded to the safe side, and only strict inequalities skip a scan,
so the codes are those of a full scan.

Vectors that are null or hold a null or non-finite component are dropped.  So
are vectors whose length isn't that of the smallest kept ``vec_id`` whose length
divides by the number of parts, and vectors with a component so large that a
sum of squares could leave 64 bits (beyond 131,072 for 64 components).  Null ids
come after all others, repeated ids are ordered by their vectors; each row gives
one result row.  With fewer rows than entries, the codebooks are that much
smaller.  An empty table gives an empty result.  Only ``vec_id``, ``embedding``
and ``label`` are read, so other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askwell.llm.common import remove, shuffle_partitions, ship_package, stored

#: groups of entries with a lower bound of their own
GROUPS = 8
#: rows handled at once within a task
ROWS = 4096
#: bounds are widened by this share against rounding
SAFE = 1e-6


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all ``entries`` (int64)."""
    if not len(x) or not len(entries):
        return np.zeros((len(x), len(entries)), np.int64)
    most = max(int(np.abs(x).max()), int(np.abs(entries).max()))
    if 4 * x.shape[1] * most * most < 1 << 53:  # whole numbers are exact in doubles up to there
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for k, e in enumerate(entries):
        out[:, k] = ((x - e) ** 2).sum(1)
    return out


def grouped(entries: np.ndarray, groups: int) -> np.ndarray:
    """Group of each entry: nearest of ``groups`` entries that lie far apart."""
    if not len(entries):
        return np.zeros(0, np.int64)
    seeds = [0]
    near = distances(entries, entries[:1])[:, 0]
    while len(seeds) < min(groups, len(entries)):
        seeds.append(int(near.argmax()))
        near = np.minimum(near, distances(entries, entries[seeds[-1:]])[:, 0])
    return distances(entries, entries[seeds]).argmin(1)


@dataclass
class Bounds:
    """Codes and bounds of the parts of some rows at one position."""

    code: np.ndarray  # (rows,) int64
    upper: np.ndarray  # (rows,) float32, of round upper_at
    upper_at: np.ndarray  # (rows,) uint8
    lower: np.ndarray  # (rows, groups) float32, of rounds lower_at
    lower_at: np.ndarray  # (rows, groups) uint8


@dataclass
class Codebook:
    """The codebooks of one part position, round by round, and what bounds of
    earlier rounds lose until the last of them."""

    history: list[np.ndarray]
    groups: int = GROUPS
    group: np.ndarray = field(init=False)
    members: list[np.ndarray] = field(init=False)

    def __post_init__(self):
        self.group = grouped(self.history[0], self.groups)
        self.members = [np.flatnonzero(self.group == g) for g in range(self.groups)]
        now, rounds = self.history[-1].astype(np.float64), len(self.history)
        #: net displacement of each entry since each round, never too small
        self.moved = np.stack([np.sqrt(((now - h) ** 2).sum(1)) * (1 + SAFE) for h in self.history])
        self.most = np.zeros((rounds, self.groups))
        self.rest = np.zeros((rounds, self.groups))
        self.who = np.full((rounds, self.groups), -1, np.int64)
        for s in range(rounds):
            for g, m in enumerate(self.members):
                if len(m):
                    order = m[np.argsort(-self.moved[s, m], kind="stable")]
                    self.who[s, g], self.most[s, g] = order[0], self.moved[s, order[0]]
                    if len(m) > 1:
                        self.rest[s, g] = self.moved[s, order[1]]

    @property
    def round(self) -> int:
        return len(self.history) - 1

    def first(self, x: np.ndarray) -> Bounds:
        """A full scan: all bounds are of the present round."""
        n = len(x)
        d = distances(x, self.history[-1])
        code = d.argmin(1)
        own = d[np.arange(n), code]
        d[np.arange(n), code] = np.iinfo(np.int64).max
        lower = np.full((n, self.groups), np.inf, np.float32)
        for g, m in enumerate(self.members):
            if len(m):
                lower[:, g] = self._low(d[:, m].min(1))
        at = np.full(n, self.round, np.uint8)
        return Bounds(code, self._high(own), at, lower, np.repeat(at[:, None], self.groups, 1))

    def later(self, x: np.ndarray, b: Bounds) -> tuple[Bounds, int]:
        """Bounds for the present round, and the distances measured for them."""
        upper = b.upper + self.moved[b.upper_at, b.code]
        columns = np.arange(self.groups)[None, :]
        loss = np.where(
            self.who[b.lower_at, columns] == b.code[:, None], self.rest[b.lower_at, columns], self.most[b.lower_at, columns]
        )
        lower = b.lower - loss
        open_rows = np.flatnonzero(upper >= lower.min(1))
        if not len(open_rows):
            return b, 0
        y, code, entries = x[open_rows], b.code[open_rows], self.history[-1]
        own = ((y - entries[code]) ** 2).sum(1)
        measured = len(open_rows)
        reach = np.sqrt(own.astype(np.float64)) * (1 + SAFE)
        low = lower[open_rows]
        scan = low <= reach[:, None]
        best, best_d = code.copy(), own.copy()
        least = np.full(low.shape, np.iinfo(np.int64).max, np.int64)
        second = least.copy()
        for g, m in enumerate(self.members):
            rows = np.flatnonzero(scan[:, g])
            if not len(rows) or not len(m):
                continue
            d = distances(y[rows], entries[m])
            measured += d.size
            k = d.argmin(1)
            here = d[np.arange(len(rows)), k]
            least[rows, g] = here
            if len(m) > 1:
                d[np.arange(len(rows)), k] = np.iinfo(np.int64).max
                second[rows, g] = d.min(1)
            better = (here < best_d[rows]) | ((here == best_d[rows]) & (m[k] < best[rows]))
            best[rows[better]], best_d[rows[better]] = m[k[better]], here[better]
        out = Bounds(*(a.copy() for a in (b.code, b.upper, b.upper_at, b.lower, b.lower_at)))
        out.code[open_rows], out.upper[open_rows], out.upper_at[open_rows] = best, self._high(best_d), self.round
        # a scanned group's bound leaves out the row's entry, which is its least
        mine = np.arange(self.groups)[None, :] == self.group[best][:, None]
        fresh = self._low(np.where(mine, second, least))
        out.lower[open_rows] = np.where(scan, fresh, out.lower[open_rows])
        out.lower_at[open_rows] = np.where(scan, self.round, out.lower_at[open_rows])
        # a group that lost the row's entry without being scanned: that entry counts from now on
        left = np.flatnonzero((best != code) & ~scan[np.arange(len(code)), self.group[code]])
        g = self.group[code[left]]
        out.lower[open_rows[left], g] = np.minimum(low[left, g] * (1 - SAFE), self._low(own[left]))
        out.lower_at[open_rows[left], g] = self.round
        return out, measured

    @staticmethod
    def _high(squared: np.ndarray) -> np.ndarray:
        return (np.sqrt(squared.astype(np.float64)) * (1 + SAFE)).astype(np.float32)

    @staticmethod
    def _low(squared: np.ndarray) -> np.ndarray:
        none = squared == np.iinfo(np.int64).max
        return np.where(none, np.inf, np.sqrt(squared.astype(np.float64)) * (1 - SAFE)).astype(np.float32)


_STATE = "vec_id long, label {label}, v binary, code binary, upper binary, upper_at binary, lower binary, lower_at binary, error long, measured long"


def _fixed(column: pa.Array, dtype, *shape: int) -> np.ndarray:
    """A binary column whose values all have one length, as an array."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    n = len(column) * math.prod(shape) * np.dtype(dtype).itemsize
    return np.frombuffer(column.buffers()[2][int(at) : int(at) + n], dtype).reshape(len(column), *shape)


def _binary(values: np.ndarray) -> pa.Array:
    """Rows of an array as a binary column."""
    flat = np.ascontiguousarray(values).reshape(len(values), -1)
    width = flat.shape[1] * flat.itemsize
    offsets = np.arange(len(flat) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])


def _assign(rows: DataFrame, books: list[np.ndarray], parts: int, first: bool, schema: str, groups: int) -> DataFrame:
    """One round: codes and bounds under ``books[-1]``; ``books`` has the
    codebooks of all rounds, each (parts, entries, width)."""
    width = books[0].shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = [Codebook([b[p] for b in books], groups) for p in range(parts)]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n = part.num_rows
                if first:
                    v = part.column(2).flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(n, parts, width)
                    old = None
                else:
                    v = _fixed(part.column(2), "<i4", parts, width)
                    old = [
                        _fixed(part.column(3), np.uint8, parts),
                        _fixed(part.column(4), "<f4", parts),
                        _fixed(part.column(5), np.uint8, parts),
                        _fixed(part.column(6), "<f4", parts, groups),
                        _fixed(part.column(7), np.uint8, parts, groups),
                    ]
                new, error, measured = [], np.zeros(n, np.int64), 0
                for p, book in enumerate(codebooks):
                    x = v[:, p].astype(np.int64)
                    if old is None:
                        b, done = book.first(x), n * len(book.group)
                    else:
                        b, done = book.later(x, Bounds(old[0][:, p].astype(np.int64), *(o[:, p] for o in old[1:])))
                    new.append(b)
                    measured += done
                    error += ((x - book.history[-1][b.code]) ** 2).sum(1)
                share = np.zeros(n, np.int64)
                share[0] = measured
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), _binary(v),
                        _binary(np.stack([b.code for b in new], 1).astype(np.uint8)),
                        _binary(np.stack([b.upper for b in new], 1).astype("<f4")),
                        _binary(np.stack([b.upper_at for b in new], 1)),
                        _binary(np.stack([b.lower for b in new], 1).astype("<f4")),
                        _binary(np.stack([b.lower_at for b in new], 1)),
                        pa.array(error), pa.array(share),
                    ],
                    ["vec_id", "label", "v", "code", "upper", "upper_at", "lower", "lower_at", "error", "measured"],
                )

    return rows.mapInArrow(run, schema)


def _moved(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The next codebook: whole means, rounded down, of the parts at each entry."""
    parts, size, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, size, width + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _fixed(batch.column(0), "<i4", parts, width).astype(np.int64)
            code = _fixed(batch.column(1), np.uint8, parts)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                which, start = np.unique(code[order, p], return_index=True)
                sums[p, which, :width] += np.add.reduceat(v[order, p], start, axis=0)
                sums[p, which, width] += np.diff(np.append(start, len(order)))
        p, e = np.nonzero(sums[:, :, width])
        place = np.tile(np.arange(width + 1), len(p))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(p, width + 1).astype(np.int32)), pa.array(np.repeat(e, width + 1).astype(np.int32)),
                pa.array(place.astype(np.int32)), pa.array(sums[p, e].ravel()),
            ],
            ["part", "entry", "place", "total"],
        )

    partial = state.select("v", "code").mapInArrow(run, "part int, entry int, place int, total long")
    # as many rows as the codebooks have numbers, whatever the size of the table
    rows = partial.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    totals = {(r["part"], r["entry"], r["place"]): int(r["total"]) for r in rows}
    out = book.copy()
    for p in range(parts):
        for e in range(size):
            if count := totals.get((p, e, width)):
                out[p, e] = [totals[p, e, k] // count for k in range(width)]
    return out


def _kept(vectors: DataFrame, parts: int, scale: int, entries: int) -> tuple[DataFrame, np.ndarray]:
    """Rows that take part, as whole numbers, and the first codebook."""
    v = vectors.select(
        vectors["vec_id"].cast("long").alias("vec_id"),
        vectors["label"].alias("label"),
        F.transform(vectors["embedding"], lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v"),
        F.transform(vectors["embedding"], lambda x: x.cast("double")).alias("_x"),
    ).filter(
        F.col("_x").isNotNull() & F.forall("_x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    )
    order = [F.col("vec_id").asc_nulls_last(), F.col("v").asc()]
    # 64-bit sums of squares hold components up to this
    reach = F.floor(F.sqrt(F.lit(float(2**61)) / F.size("v")))
    fits = v.filter((F.size("v") > 0) & (F.size("v") % parts == 0)).filter(
        F.forall("_x", lambda x: F.abs(x) * F.lit(float(scale)) < reach)
    )
    head = fits.orderBy(*order).limit(1).select("v").collect()
    if not head:
        return fits, np.zeros((parts, 0, 1), np.int64)
    width = len(head[0]["v"])
    rows = fits.filter(F.size("v") == width)
    first = rows.orderBy(*order).limit(entries).select("v").collect()
    book = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, width // parts)
    return rows.select("vec_id", "label", F.col("v").cast("array<int>").alias("v")), book.transpose(1, 0, 2).copy()


@dataclass
class Compressed:
    """Codes of all rows, the final codebooks (parts, entries, width), and the
    distances measured in each round."""

    rows: DataFrame
    books: np.ndarray
    measured: list[int]


def compress(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, groups: int = GROUPS
) -> Compressed:
    """Learn codebooks in ``rounds`` and code every row.

    ``rows`` has ``vec_id, label, code (binary), error``: the entries' numbers
    in the order of the parts (``entries`` is at most 256) and the final squared
    distance, summed over the parts.
    """
    if entries > 256:
        raise ValueError("a code is one byte for each part: entries can't be over 256")
    spark = vectors.sparkSession
    ship_package(spark)
    label = vectors.schema["label"].dataType
    rows, book = _kept(vectors, parts, scale, entries)
    if not book.shape[1]:
        schema = T.StructType().add("vec_id", "long").add("label", label).add("code", "binary").add("error", "long")
        return Compressed(spark.createDataFrame([], schema), book, [])
    schema = _STATE.format(label=label.simpleString())
    books, measured, state, last = [book], [], rows, None
    for r in range(rounds + 1):
        state, path = stored(_assign(state, books, parts, r == 0, schema, groups), f"codes-round{r}")
        if last:
            remove(spark, last)  # the new state holds all that is needed of it
        last = path
        measured.append(state.agg(F.sum("measured")).first()[0] or 0)
        if r < rounds:
            books.append(_moved(state, books[-1]))
    return Compressed(state.select("vec_id", "label", "code", "error"), books[-1], measured)


def decompress(compressed: Compressed, scale: int = 1024) -> DataFrame:
    """Vectors that the codes stand for: ``vec_id, vector``."""
    book = compressed.books / scale
    parts, _, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = _fixed(batch.column(1), np.uint8, parts)
            v = np.concatenate([book[p, code[:, p]] for p in range(parts)], axis=1)
            lists = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * (parts * width), v.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["vec_id", "vector"])

    return compressed.rows.select("vec_id", "code").mapInArrow(run, "vec_id long, vector array<double>")


def with_label_error(rows: DataFrame) -> DataFrame:
    """``label_error``: errors summed over equal labels, nulls together.

    Sums are few and rows of one label may be many, so sums are copied to as many
    keys as there are partitions and rows choose among them by hash."""
    salts = shuffle_partitions(rows.sparkSession)
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).select(
        F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_copy")
    )
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(salts)).cast("int"))
    same = F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_copy"))
    return salted.join(sums, same).drop("_label", "_copy", "_salt")


def op11_query(spark, sf_dir: str) -> DataFrame:
    done = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    numbers = ",".join(map(str, done.books.ravel().tolist()))
    return with_label_error(done.rows).select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(hashlib.sha256(numbers.encode()).hexdigest()).alias("codebooks_sha256"),
    )


def _oracle(rounds: int = 4) -> str:
    """The same codes by full scans in DuckDB."""
    squares = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x.v, c.v)])"
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"code{r} AS MATERIALIZED (SELECT x.rid, x.part, min({squares} * 256 + c.entry) AS best "
            f"FROM cut x JOIN book{r} c ON x.part = c.part GROUP BY x.rid, x.part)"
        )
        if r < rounds:
            steps.append(
                f"mean{r} AS (SELECT part, entry, list((total - ((total % n) + n) % n) // n ORDER BY place) AS v FROM ("
                f"SELECT x.part, k.best % 256 AS entry, u.place, sum(x.v[u.place])::BIGINT AS total, count(*) AS n "
                f"FROM cut x JOIN code{r} k ON x.rid = k.rid AND x.part = k.part, "
                f"(SELECT unnest(range(1, (SELECT max(len(v)) FROM cut) + 1)) AS place) u GROUP BY ALL) GROUP BY part, entry), "
                f"book{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v "
                f"FROM book{r} b LEFT JOIN mean{r} m ON b.part = m.part AND b.entry = m.entry)"
            )
    return f"""
WITH ints AS (
  SELECT vec_id, label, [floor(1024::DOUBLE * x::DOUBLE)::BIGINT for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), kept AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid FROM ints
), cut AS MATERIALIZED (
  SELECT rid, p.part, v[p.part * (len(v) // 4) + 1 : (p.part + 1) * (len(v) // 4)] AS v
  FROM kept, (SELECT unnest(range(4)) AS part) p
), book0 AS MATERIALIZED (
  SELECT part, rid - 1 AS entry, v FROM cut WHERE rid <= 256
), {", ".join(steps)}, coded AS (
  SELECT rid, string_agg(lpad(format('{{:x}}', (best % 256)::BIGINT), 2, '0'), '' ORDER BY part) AS code,
         sum(best // 256)::BIGINT AS error
  FROM code{rounds} GROUP BY rid
), written AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}
)
SELECT k.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, w.codebooks_sha256
FROM kept k JOIN coded c USING (rid), written w
"""


OP11_SQL = _oracle()
