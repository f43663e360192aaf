"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is then routed to a leaf
and indexed.  A query walks the tree best bin first: a priority queue holds the
open branches by their distance to the query, and leaves come out nearest first.
How many vectors a query may meet before it stops is calibrated: sample vectors
serve as queries against the sample, and the budget widens until their mean
recall reaches ``target``.  Leaves that a query visits are joined with it, and
only distances on the original vectors in double precision decide.

Within a batch, at most ``k`` rows of one id and vector and ``2 k`` rows of one
vector, smallest ids first, are indexed: a query leaves out the rows of one id, its
own, so no other copy can be among its k nearest (as ties go to the smaller id, this
is exact).  A leaf with more rows than ``leaf_rows`` is cut into chunks, each its
own piece of work.

Defined cases: vectors that are null, zero or hold null or non-finite components
take no part, nor do those with a null id or of another length than the first
id's vector; a query with fewer candidates gets all; an empty table gives an empty
result; other columns are not read.  Rows are candidates one by one, so a candidate
id that stands in several rows may take several ranks.  A query is an id: its rows
of one vector ask once, and where they hold different vectors, each candidate row
counts once, by its distance to the nearest of them.  Rows of the query's id are
never its neighbours.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.llm.common import bounded_sample, materialize, ship_package, shuffle_partitions

SAMPLE = 20_000  # vectors that the tree is fitted on, at most
CALIBRATION = 200  # sample vectors that serve as calibration queries


class KMeansTree:
    """Inner vertices hold centres of their children; leaves are numbered."""

    def __init__(self, sample: np.ndarray, branching: int, leaf: int, seed: int = 1):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []  # vertex numbers, or -1 - leaf
        self.leaves = 0
        self.rng = np.random.default_rng(seed)
        self.branching, self.leaf = branching, leaf
        self.root = self._grow(sample)

    def _grow(self, rows: np.ndarray) -> int:
        if len(rows) <= self.leaf or (rows == rows[0]).all():
            self.leaves += 1
            return -self.leaves
        centres, own = self._cluster(rows)
        me = len(self.centres)
        self.centres.append(centres)
        self.children.append([])
        self.children[me] = [self._grow(rows[own == c]) for c in range(len(centres))]
        return me

    def _cluster(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        distinct = np.unique(rows, axis=0)
        centres = distinct[self.rng.choice(len(distinct), min(self.branching, len(distinct)), replace=False)]
        for _ in range(8):
            own = squared(rows, centres).argmin(1)
            used = np.unique(own)
            centres = np.stack([rows[own == c].mean(0) for c in used])
        own = squared(rows, centres).argmin(1)
        used, own = np.unique(own, return_inverse=True)
        return centres[used], own

    def route(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest centre, level by level."""
        out = np.zeros(len(rows), np.int64)
        todo = [(self.root, np.arange(len(rows)))]
        while todo:
            at, who = todo.pop()
            if at < 0:
                out[who] = -1 - at
            elif len(who):
                nearest = squared(rows[who], self.centres[at]).argmin(1)
                todo += [(c, who[nearest == k]) for k, c in enumerate(self.children[at])]
        return out

    def best_first(self, query: np.ndarray, sizes: np.ndarray, budget: int) -> list[int]:
        """Leaves, nearest open branch first, until they hold ``budget`` vectors."""
        heap: list[tuple[float, int]] = [(0.0, self.root)]
        out, met = [], 0
        while heap and met < budget:
            _, at = heapq.heappop(heap)
            while at >= 0:
                d = ((self.centres[at] - query) ** 2).sum(1)
                nearest = int(d.argmin())
                for k, c in enumerate(self.children[at]):
                    if k != nearest:
                        heapq.heappush(heap, (float(d[k]), c))
                at = self.children[at][nearest]
            out.append(-1 - at)
            met += int(sizes[-1 - at])
        return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)


def calibrate(tree: KMeansTree, sample: np.ndarray, k: int, target: float) -> float:
    """Share of the vectors that a query must meet for the target recall."""
    n = len(sample)
    if n <= k + 1:
        return 1.0
    leaf = tree.route(sample)
    sizes = np.bincount(leaf, minlength=tree.leaves)
    queries = np.random.default_rng(2).choice(n, min(CALIBRATION, n), replace=False)
    orders = []
    for q in queries:
        d = ((sample - sample[q]) ** 2).sum(1)
        d[q] = np.inf
        true = np.argsort(d, kind="stable")[:k]
        place = np.full(tree.leaves, n, np.int64)  # vectors met before each leaf is reached
        met = 0
        for x in tree.best_first(sample[q], sizes, n + 1):
            place[x] = met
            met += int(sizes[x])
        orders.append(place[leaf[true]])
    before = np.concatenate(orders)
    share = 0.02
    while share < 1:
        if (before < share * n).mean() >= target:
            break
        share *= 1.15
    return min(1.0, share)


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("vector")
    slim = vectors.select(
        vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("vector")
    ).filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return slim.filter(finite & F.exists(v, lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _place(same: np.ndarray) -> np.ndarray:
    """Place of each row in its run, where ``same`` says that it goes on the run of
    the row before."""
    at = np.arange(len(same))
    return at - np.maximum.accumulate(np.where(same, 0, at))


def nearest(
    vectors: DataFrame,
    every: int = 100,
    k: int = 10,
    target: float = 0.99,
    branching: int = 16,
    leaf: int = 256,
    leaf_rows: int = 20_000,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest vectors of each one whose id is divisible by ``every``.

    Returns ``query_id, rank, vec_id, score`` (Euclidean distance).
    """
    spark = vectors.sparkSession
    ship_package(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    clean = _clean(vectors, id_col, vector_col)
    head = clean.select("vec_id", F.size("vector").alias("n")).orderBy("vec_id", "n").limit(1).collect()
    if not head:
        return spark.createDataFrame([], schema)
    clean = clean.filter(F.size("vector") == head[0]["n"])
    drawn = bounded_sample(clean, "vec_id", SAMPLE, 5).select("vector").toPandas()
    sample = np.stack(drawn["vector"].to_numpy())
    tree = KMeansTree(sample, branching, leaf)
    share = calibrate(tree, sample, k, target)
    held = spark.sparkContext.broadcast(tree)  # at most SAMPLE centres

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ids, rows = batch.column(0).to_numpy(), _matrix(batch.column(1))
            leaves = held.value.route(rows)
            by = np.lexsort((ids, *rows.T[::-1]))
            same = np.append(False, (rows[by[1:]] == rows[by[:-1]]).all(1))
            of_id = _place(same & np.append(False, ids[by[1:]] == ids[by[:-1]]))
            few = of_id < k  # holds for the first row of every run
            by, same, of_id = by[few], same[few], of_id[few]
            # the first row of each query and vector stays, wherever it stands
            keep = np.sort(by[(_place(same) < 2 * k) | ((ids[by] % every == 0) & (of_id == 0))])
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaves[keep]), batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at)],
                ["leaf", "vec_id", "vector", "row"],
            )

    # the row's key is written with it, so it stays the same for all that follows
    keyed = clean.withColumn("row", F.monotonically_increasing_id())
    indexed = materialize(keyed.mapInArrow(index, "leaf long, vec_id long, vector array<double>, row long"), "ann-index")
    sizes = np.zeros(tree.leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # one row per leaf of the bounded tree
        sizes[r["leaf"]] = r["count"]
    total = int(sizes.sum())
    budget = max(int(np.ceil(share * total)), 2 * (k + 1))
    known = spark.sparkContext.broadcast(sizes)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, rows = [], []
            for i, q in enumerate(_matrix(batch.column(1))):
                for x in held.value.best_first(q, known.value, budget):
                    for c in range(max(1, -(-int(known.value[x]) // leaf_rows))):
                        leaves.append((x, c))
                        rows.append(i)
            at = pa.array(np.array(rows, np.int64))
            pairs = np.array(leaves, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.zeros(len(rows), np.int8)),
                 batch.column(0).take(at), batch.column(1).take(at), pa.array(np.zeros(len(rows), np.int64))],
                ["leaf", "chunk", "kind", "id", "vector", "row"],
            )

    queries = indexed.filter(F.col("vec_id") % every == 0).select("vec_id", "vector").distinct()
    work = "leaf long, chunk long, kind byte, id long, vector array<double>, row long"
    asked = queries.mapInArrow(visit, work)
    chunks = spark.createDataFrame(
        [(x, -(-int(n) // leaf_rows)) for x, n in enumerate(sizes.tolist()) if n > leaf_rows], "_leaf long, _chunks long"
    )
    stored = indexed.join(F.broadcast(chunks), F.col("leaf") == F.col("_leaf"), "left").select(
        "leaf", F.coalesce(F.pmod(F.xxhash64("row"), F.col("_chunks")), F.lit(0)).alias("chunk"),
        F.lit(1).cast("byte").alias("kind"), F.col("vec_id").alias("id"), "vector", "row",
    )
    n = shuffle_partitions(spark)
    dealt = asked.unionByName(stored).repartition(n, "leaf", "chunk").sortWithinPartitions("leaf", "chunk", "kind", "id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's k nearest among all leaves that this task holds."""
        best_of: list[tuple[np.ndarray, ...]] = []
        held_rows = 0

        def compact() -> None:
            """Keep k rows a query, each row once, ties to the smaller id."""
            who, own_id, d, row = (np.concatenate(c) for c in zip(*best_of, strict=True))
            by = np.lexsort((d, row, who))
            again = (who[by[1:]] == who[by[:-1]]) & (row[by[1:]] == row[by[:-1]])
            by = by[np.append(True, ~again)] if len(by) else by
            by = by[np.lexsort((own_id[by], d[by], who[by]))]
            by = by[_place(np.append(False, who[by[1:]] == who[by[:-1]])) < k] if len(by) else by
            best_of[:] = [(who[by], own_id[by], d[by], row[by])]

        here: tuple[int, int] | None = None
        ids, rows = np.zeros(0, np.int64), None
        for batch in batches:
            leaf_, chunk, kind, own = (batch.column(c).to_numpy() for c in range(4))
            vec, row = _matrix(batch.column(4)), batch.column(5).to_numpy()
            change = (np.diff(leaf_) != 0) | (np.diff(chunk) != 0) | (np.diff(kind) != 0)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(leaf_)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if here != (int(leaf_[a]), int(chunk[a])):
                    here, ids, rows = (int(leaf_[a]), int(chunk[a])), np.zeros(0, np.int64), None
                if kind[a] == 0:
                    ids = np.concatenate([ids, own[a:b]])
                    rows = vec[a:b] if rows is None else np.concatenate([rows, vec[a:b]])
                    continue
                if rows is None:
                    continue
                step = max(1, 2_000_000 // ((b - a) * vec.shape[1]))
                for q in range(0, len(ids), step):
                    d = np.sqrt(((rows[q : q + step, None, :] - vec[None, a:b]) ** 2).sum(2))
                    d[ids[q : q + step, None] == own[None, a:b]] = np.inf
                    take = min(k, b - a)
                    # stored rows come by id, so a stable sort leaves ties to the smaller one
                    best = np.argsort(d, axis=1, kind="stable")[:, :take]
                    score = np.take_along_axis(d, best, 1).ravel()
                    who = np.repeat(ids[q : q + step], take)
                    fine = np.isfinite(score)
                    best_of.append((who[fine], own[a:b][best.ravel()][fine], score[fine], row[a:b][best.ravel()][fine]))
                    held_rows += int(fine.sum())
                    if held_rows > 500_000:
                        compact()
                        held_rows = 0
        if best_of:
            compact()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best_of[0][:3]], ["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(measure, "query_id long, vec_id long, score double")
    # a query's rows: k for each task that holds some of its leaves; a stored row is in one task
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact_nearest(vectors: DataFrame, every: int, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Brute force for measuring recall: the stated queries, in one broadcast block
    of at most SAMPLE rows, against all rows."""
    spark = vectors.sparkSession
    clean = _clean(vectors, id_col, vector_col)
    got = clean.filter(F.col("vec_id") % every == 0).orderBy("vec_id").limit(SAMPLE).toPandas()
    held = spark.sparkContext.broadcast((got["vec_id"].to_numpy(), np.stack(got["vector"].to_numpy())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = held.value
        for batch in batches:
            own, vec = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for q, v in zip(ids.tolist(), rows, strict=True):
                d = np.sqrt(((vec - v) ** 2).sum(1))
                d[own == q] = np.inf
                best = np.lexsort((own, d))[:k]
                best = best[np.isfinite(d[best])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(best), q)), pa.array(own[best]), pa.array(d[best])], ["query_id", "vec_id", "score"]
                )

    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = clean.mapInArrow(run, "query_id long, vec_id long, score double")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
