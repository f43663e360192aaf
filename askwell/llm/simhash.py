"""Near-duplicate documents by SimHash fingerprints and vantage-point trees.

Fingerprints: each document's shingles are hashed to 64 bits; a bit is set if it
is set in more than half of the hashes.  Equal fingerprints are one node.

Search: two fingerprints that differ in at most ``max_bits`` bits share their
differences among ``blocks`` disjoint bit blocks, so in some block they differ
in at most ``max_bits // blocks`` bits.  Each block has a vantage-point tree:
a vertex holds a vantage value and one branch per Hamming distance to it.  A
fingerprint is stored in the one leaf its own distances lead to.  It is asked
for in every leaf that the triangle inequality leaves open, i.e. along all
branches within the block's share of the radius; those are the shards whose
border it overlaps.  With the default of five blocks the share is 0 and a
fingerprint visits its own leaf only; with fewer blocks it is copied to the
neighbouring shards, too.  Trees are fitted on a bounded sample, but they only
steer rows: any tree gives exact pairs.

Leaves are compared inside tasks.  A leaf of more than ``leaf_rows`` rows is cut
into chunks and each pair of chunks is its own piece of work.  A piece emits
only links that join two parts not yet joined inside it, never all pairs.

Components: links become stars round the smallest node in rounds of joins.

Defined cases: a null or empty text and one of white space only have
fingerprint zero, and link like any other; null ids come before all others and
stay null in the result; repeated rows each get a row; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askwell.llm.common import bounded_sample, materialize, ship_package, shuffle_partitions

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
SAMPLE = 20_000  # fingerprints that the trees are fitted on, at most


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of one text: words split at ASCII white space, A-Z lower-cased."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], "<u8"
    )
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    out = 0
    for j in range(8):
        ones = np.bincount(by_byte[:, j], minlength=256) @ _BITS
        out |= sum(1 << (8 * j + k) for k in range(8) if 2 * ones[k] > len(hashes))
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, text_col: str = "text", tie: bool = False) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long, one row per row.  With
    ``tie`` also that column, a hash of the text."""
    ship_package(docs.sparkSession)
    more = ["tie"] if tie else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fp = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(fp.view(np.int64)), *(part.column(2 + k) for k in range(len(more)))],
                    ["doc_id", "fp", *more],
                )

    text = docs[text_col].cast("string")
    slim = [docs["doc_id"].cast("long").alias("doc_id"), text.alias("text")]
    if tie:
        slim.append(F.xxhash64(text).alias("tie"))
    return docs.select(*slim).mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", "fp", *more]))


class VantageTree:
    """A tree over one bit block: vertices are lists of (vantage, branches)."""

    def __init__(self, sample: np.ndarray, mask: int, leaf: int, seed: int):
        self.mask = np.uint64(mask)
        self.width = mask.bit_count()
        self.vantage: list[int] = []
        self.branch: list[dict[int, int]] = []
        rng = np.random.default_rng(seed)
        todo: list[tuple[np.ndarray, int, int]] = [(np.unique(sample & self.mask), -1, 0)]
        # a vertex splits its part of the sample by the distance to a random member
        while todo:
            rows, above, by = todo.pop()
            me = len(self.vantage)
            if above >= 0:
                self.branch[above][by] = me
            if len(rows) <= leaf:
                self.vantage.append(-1)
                self.branch.append({})
                continue
            v = rows[rng.integers(len(rows))]
            self.vantage.append(int(v))
            self.branch.append({})
            d = np.bitwise_count(rows ^ v)
            todo += [(rows[d == x], me, int(x)) for x in np.unique(d)]

    def leaves(self, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf within ``radius`` of each fingerprint.

        A distance without a branch has a leaf of its own.  Radius 0 gives each
        row's own leaf.
        """
        rows, found = [], []
        own = fp & self.mask
        todo = [(0, np.arange(len(fp)))]
        while todo:
            at, who = todo.pop()
            if not len(who):
                continue
            if self.vantage[at] < 0:
                rows.append(who)
                found.append(np.full(len(who), at * 128 + 127, np.int64))
                continue
            d = np.bitwise_count(own[who] ^ np.uint64(self.vantage[at])).astype(np.int64)
            for x in range(max(0, int(d.min()) - radius), min(self.width, int(d.max()) + radius) + 1):
                inside = who[np.abs(d - x) <= radius]
                if x in self.branch[at]:
                    todo.append((self.branch[at][x], inside))
                elif len(inside):
                    rows.append(inside)
                    found.append(np.full(len(inside), at * 128 + x, np.int64))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(found)


def block_masks(blocks: int) -> list[int]:
    """``blocks`` disjoint masks of neighbouring bits that cover all 64."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _forest(fp: np.ndarray, home: np.ndarray, max_bits: int, split: int | None) -> list[tuple[int, int]]:
    """Links inside one piece of work that join two parts not joined before.

    ``split``: rows before it are compared with those from it on, and with no others.
    """
    n = len(fp)
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    rows = n if split is None else split
    step = max(1, 2_000_000 // max(n, 1))
    for a in range(0, rows, step):
        b = min(rows, a + step)
        first = a + 1 if split is None else split
        near = np.bitwise_count(fp[a:b, None] ^ fp[None, first:]) <= max_bits
        near &= home[a:b, None] | home[None, first:]
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            x, y = a + i, first + j
            if x < y:
                p, q = top(x), top(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((x, y))
    return out


def links(nodes: DataFrame, max_bits: int = 4, blocks: int = 5, leaf_sample: int = 8, leaf_rows: int = 4096) -> DataFrame:
    """Links ``a, b`` (a < b) between distinct fingerprints ``fp``.

    Two fingerprints are joined by a path of links iff they are joined by a path
    of pairs that differ in at most ``max_bits`` bits.
    """
    spark = nodes.sparkSession
    ship_package(spark)
    share = max_bits // blocks
    n = shuffle_partitions(spark)
    sample = np.array(
        [r[0] for r in bounded_sample(nodes.select("fp"), "fp", SAMPLE, 7).collect()], np.int64
    ).view(np.uint64)
    trees = [VantageTree(sample, m, leaf_sample, k) for k, m in enumerate(block_masks(blocks))]
    held = spark.sparkContext.broadcast(trees)  # at most SAMPLE vertices a tree

    def steer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for k, tree in enumerate(held.value):
                rows, leaf = tree.leaves(fp, share)
                own = np.zeros(len(fp), np.int64)
                at, own_leaf = tree.leaves(fp, 0) if share else (rows, leaf)
                own[at] = own_leaf
                home = leaf == own[rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf * blocks + k), pa.array(fp[rows].view(np.int64)), pa.array(home)],
                    ["leaf", "fp", "home"],
                )

    steered = nodes.select("fp").mapInArrow(steer, "leaf long, fp long, home boolean")
    if share:
        steered = steered.groupBy("leaf", "fp").agg(F.max("home").alias("home"))
    placed = materialize(steered, "simhash-leaves")
    large = placed.groupBy("leaf").count().filter(F.col("count") > leaf_rows).select(
        F.col("leaf").alias("_leaf"), F.ceil(F.col("count") / leaf_rows).cast("int").alias("_chunks")
    )
    chunk = F.pmod(F.xxhash64("fp"), F.col("_chunks")).cast("int")
    cut = placed.join(large, F.col("leaf") == F.col("_leaf"), "left").withColumn("_c", chunk)
    small_part = cut.filter("_chunks is null").select("leaf", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "fp", "home")
    # each row of a large leaf meets every chunk: once as part of each pair of chunks
    large_part = cut.filter("_chunks is not null").select(
        "leaf", "_c", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_o"), "fp", "home"
    ).select(
        "leaf", F.least("_c", "_o").alias("i"), F.greatest("_c", "_o").alias("j"),
        F.when(F.col("_c") <= F.col("_o"), 0).otherwise(1).alias("side"), "fp", "home",
    )
    # in a pair of different chunks, the first chunk's rows are side 0
    work = small_part.unionByName(large_part)
    dealt = work.repartition(n, "leaf", "i", "j").sortWithinPartitions("leaf", "i", "j", "side", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] | None = None

        def pieces() -> Iterator[list[np.ndarray]]:
            """Rows of whole pieces of work, in order."""
            nonlocal left
            for batch in batches:
                cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
                if left is not None:
                    cols = [np.concatenate([x, y]) for x, y in zip(left, cols, strict=True)]
                new = (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)
                cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    yield [c[a:b] for c in cols]
                left = [c[cuts[-1] :] for c in cols]
            if left is not None and len(left[0]):
                yield left

        a: list[int] = []
        b: list[int] = []
        for _, i, j, side, fp, home in pieces():
            if len(fp) < 2:
                continue
            split = None if i[0] == j[0] else int(np.searchsorted(side, 1))
            for x, y in _forest(fp.view(np.uint64), home, max_bits, split):
                a.append(int(min(fp[x], fp[y])))
                b.append(int(max(fp[x], fp[y])))
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, root``: the smallest node of each node's component.

    Alternates two steps on the whole edge table until nothing changes: every
    node links its larger neighbours to its smallest one, then its smaller
    neighbours to the smallest.  A hub's neighbours are only ever summed up by
    a minimum, which Spark takes before the shuffle.
    """
    edges = materialize(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), name
    )
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(
            both.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct(),
            name,
        )
        # small step: u's neighbours below it, and u, go to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = materialize(
            large.join(low, "b")
            .select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), "b"))).alias("e"))
            .select("e.a", "e.b").filter("a < b").distinct(),
            name,
        )
        # done when every edge is (root, node): no node is both
        middle = small.select(F.col("b").alias("node")).intersect(small.select(F.col("a").alias("node")))
        twice = small.groupBy("b").count().filter("count > 1")
        edges = small
        if middle.isEmpty() and twice.isEmpty():
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, blocks: int = 5, text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Documents link if their fingerprints differ in at most ``max_bits`` bits;
    ``component_id`` is the smallest id reachable (null where no row of the
    component has an id).
    """
    fps = materialize(fingerprints(docs, shingle, text_col), "simhash-fp")
    by_fp = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-nodes")
    rooted = _rooted(by_fp, max_bits, blocks)
    # the smallest id of each component: over one row per fingerprint
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = rooted.join(named, "root").select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(of_fp, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _rooted(by_fp: DataFrame, max_bits: int, blocks: int = 5) -> DataFrame:
    """``fp, root, low``: the fingerprint that names each one's component."""
    comp = components(links(by_fp.select("fp"), max_bits, blocks), "simhash-edges")
    return by_fp.join(comp, by_fp["fp"] == comp["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")


def keep_first(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of ``docs`` for each component: the one with its smallest id, a
    null id only where no row of the component has another.  Of rows that share
    that id the one whose text has the smallest hash stays, of equal texts the
    first as stored."""
    fps = fingerprints(docs, shingle, tie=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("low")
    by_fp = materialize(fps.groupBy("fp").agg(first), "simhash-nodes")
    low = _rooted(by_fp, max_bits).groupBy("root").agg(F.min("low").alias("low"))
    # a key of (no id, id, hash of the text) that equals itself where the id is null
    key = ["none", "id", "tie"]
    keep = low.select("low.none", F.coalesce("low.doc_id", F.lit(0)).alias("id"), "low.tie")
    # the whole row travels as one field, so no name of its columns can clash
    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id"),
        F.xxhash64(docs["text"].cast("string")).alias("tie"), F.monotonically_increasing_id().alias("at"),
    )
    firsts = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("at"))).filter("nth = 1")
    return firsts.join(keep, key, "left_semi").select("row.*")


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

