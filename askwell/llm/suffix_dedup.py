"""Removal of repeated passages with a sparse, distributed suffix array.

Every byte covered by a ``length``-byte string that also starts earlier (smaller
id, or same document and earlier start) is removed.

* Of all suffixes only those at anchors are sorted.  An anchor is the smallest
  ``gram``-byte string (by hash, leftmost on ties) of some ``length``-byte
  window, so every window has one, and equal windows have it at the same place.
  Neighbouring windows with one anchor form a run; about one byte in 35 starts
  a run on prose.
* Sampled splitters range-partition the suffixes by their leading bytes (the
  anchor), then by the bytes round them (the run), document and place; a
  frequent anchor is therefore dealt over as many buckets as it needs.  Buckets
  are sorted locally and neighbours compared; what a bucket can't see across
  its borders is settled from two rows per bucket.
* Runs with the same bytes: all but the first are removed.  Where an anchor has
  several different runs, their bytes (under 200 each) meet by anchor and their
  windows are compared there.  An anchor with more than MOST_RUNS of them, or
  one that goes on beyond its bucket, has its windows dealt out one by one:
  again range-partitioned, sorted and compared with their neighbours.

Bytes are compared by two independent 64-bit hashes (the anchor's and the run's
or window's), 128 bits in all.

Defined cases: null text counts as empty; null ids come before all others; rows
that share an id count as one document, so neither of two such rows with the same
start is earlier, and each loses only bytes that it has itself (a mark carries
their hash); an empty table gives an empty result;
other columns are not read.  Very long texts are hashed in slices that overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.llm.common import (
    bounded_sample,
    order_id,
    remove,
    ship_package,
    shuffle_partitions,
    shuffles_released,
    stored,
    text_or_empty,
)

SLICE = 1 << 18  # bytes hashed at once
MOST_RUNS = 2_000  # different runs of one anchor that are compared in one task
SAMPLE_DOCS = 2_000  # documents that the splitters are chosen from, at most
_U = np.uint64
_TABLE = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.int64).astype(_U) * _U(0x9E3779B97F4A7C15)
_P1, _P2, _P3 = _U(0xC2B2AE3D27D4EB4F), _U(0x9FB21C651E98DF25), _U(0xD6E8FEB86659FD93)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _P1 + b
    h ^= h >> _U(32)
    h *= _P2
    h ^= h >> _U(29)
    return h


def _power_hashes(raw: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of all 32-byte and 64-byte strings of ``raw``."""
    h, out = _TABLE[raw], {}
    for m in (1, 2, 4, 8, 16, 32):
        h = _mix(h[: max(len(h) - m, 0)], h[m:])
        if m >= 16:
            out[2 * m] = h
    return out


def _span_hash(h64: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the strings of ``size`` (64 to 192) bytes from ``at``."""
    return _mix(_mix(h64[at], h64[at + (size - 64) // 2]), h64[at + size - 64] + size.astype(_U) * _P3)


def _smallest(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    m, done = key, 1
    while 2 * done <= width:
        m = np.minimum(m[:-done], m[done:])
        done *= 2
    rest = width - done
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def runs_of(raw: bytes, borders: np.ndarray, length: int, gram: int = 32) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, in texts that stand one after another.

    ``borders``: where each text begins, and the end.  Returns the text's
    number, the run's first window (from the start of ``raw``), its number of
    windows, the anchor's hash and the hash of all bytes that the run covers.
    """
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(_U), none.view(_U)
    h = _power_hashes(np.frombuffer(raw, np.uint8))
    order = ((h[gram] * _P3) >> _U(32) << _U(32)) | np.arange(len(h[gram]), dtype=_U)
    anchor = (_smallest(order, length - gram + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    last = borders[1:] - length  # last window of each text
    fits = last >= borders[:-1]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, borders[:-1][fits], 1)
    np.add.at(step, last[fits] + 1, -1)
    valid = np.cumsum(step)[: len(anchor)] > 0
    head = np.empty(len(anchor), bool)
    head[0] = True
    head[1:] = anchor[1:] != anchor[:-1]
    starts = borders[:-1][fits]
    head[starts] = True
    heads = np.flatnonzero(head & valid)
    text = np.searchsorted(borders, heads, side="right") - 1
    # texts of no bytes share a border: the last of them holds the window
    ends = np.minimum(np.append(heads[1:], n), last[text] + 1)
    count = ends - heads
    return text, heads, count, h[gram][anchor[heads]], _span_hash(h[64], heads, count + length - 1)


def _slices(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined to slices of about SLICE bytes, longer ones cut so that each
    window lies in one slice: (bytes, borders, text numbers, offsets in the text)."""
    parts: list[bytes] = []
    who: list[int] = []
    base: list[int] = []
    size = 0

    def done():
        return b"".join(parts), np.cumsum([0, *map(len, parts)]), np.array(who), np.array(base)

    for k, t in enumerate(texts):
        if len(t) < length:
            continue
        for at in range(0, max(len(t) - length + 1, 1), SLICE):
            piece = t[at : at + SLICE + length - 1]
            if size and size + len(piece) > 2 * SLICE:
                yield done()
                parts, who, base, size = [], [], [], 0
            parts.append(piece)
            who.append(k)
            base.append(at)
            size += len(piece)
    if parts:
        yield done()


ROW = "bucket int, g long, h long, doc long, at long"
_ROW_NAMES = ["bucket", "g", "h", "doc", "at"]


class Splitters:
    """Sorted sample rows (g, h, doc, at); a row's bucket is the number of them
    that are not above it."""

    def __init__(self, rows: list[tuple[int, int, int, int]], buckets: int):
        rows = sorted(set(rows))
        step = max(len(rows) / buckets, 1)
        self.rows = [rows[int(k * step)] for k in range(1, buckets) if int(k * step) < len(rows)]
        self.g = np.array([r[0] for r in self.rows], np.int64)

    def bucket(self, g: np.ndarray, h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        import bisect

        out = np.searchsorted(self.g, g, side="left")
        if len(self.g):
            for k in np.flatnonzero(self.g[np.minimum(out, len(self.g) - 1)] == g):
                out[k] = bisect.bisect_right(self.rows, (int(g[k]), int(h[k]), int(doc[k]), int(at[k])))
        return out.astype(np.int32)


def _batch(cols: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)


def _run_rows(docs: DataFrame, length: int, split) -> DataFrame:
    """All runs of ``docs`` (doc, text); ``at`` holds first window * 128 + windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = part.column(0).to_numpy()
                texts = [t.encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                for raw, borders, who, base in _slices(texts, length):
                    text, heads, count, g, h = runs_of(raw, borders, length)
                    doc = ids[who[text]]
                    at = (heads - borders[text] + base[text]) * 128 + count
                    g, h = g.view(np.int64), h.view(np.int64)
                    bucket = split.value.bucket(g, h, doc, at) if split else np.zeros(len(g), np.int32)
                    yield _batch([bucket, g, h, doc, at], _ROW_NAMES)

    return docs.mapInArrow(run, ROW)


RUN_BYTES = "g long, doc long, at long, wide boolean, raw binary"


def _run_bytes(length: int):
    """(doc, text, runs) -> the bytes of each listed run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py().encode("utf-8", "surrogatepass")
                listed = batch.column(2)[k].values
                # of rows that share an id, a shorter one doesn't hold all runs
                fits = (listed.field(0).to_numpy() >> 7) + (listed.field(0).to_numpy() & 127) - 1 + length <= len(text)
                listed = listed.filter(pa.array(fits))
                at, g, wide = listed.field(0), listed.field(1), listed.field(2)
                raw = [text[a >> 7 : (a >> 7) + (a & 127) - 1 + length] for a in at.to_pylist()]
                doc = pa.array(np.full(len(at), batch.column(0)[k].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([g, doc, at, wide, pa.array(raw, pa.binary())], [c.split()[0] for c in RUN_BYTES.split(", ")])

    return run


def _windows(g: np.ndarray, doc: np.ndarray, at: np.ndarray, raw: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Of each run every window: its hash, the anchor, the document, its start."""
    many = at & 127
    size = many + length - 1
    h64 = _power_hashes(np.frombuffer(b"".join(raw), np.uint8))[64]
    inside = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    place = np.repeat(np.cumsum(size) - size, many) + inside
    w = _span_hash(h64, place, np.full(len(place), length)).view(np.int64)
    return w, np.repeat(g, many), np.repeat(doc, many), np.repeat(at >> 7, many) + inside


def _parts(batch: pa.RecordBatch, most: int = 4096) -> Iterator[tuple]:
    for a in range(0, batch.num_rows, most):
        part = batch.slice(a, most)
        yield *(part.column(k).to_numpy() for k in range(3)), part.column(3).to_pylist()


def _met(runs: DataFrame, length: int) -> DataFrame:
    """(doc, at, h) of single windows that equal an earlier one of the same anchor."""

    def settle(g, doc, at, raw) -> pa.RecordBatch:
        w, anchor, d, start = _windows(g, doc, at, raw, length)
        by = np.lexsort((start, d, w, anchor))
        w, anchor, d, start = w[by], anchor[by], d[by], start[by]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (anchor[1:] != anchor[:-1])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (d != d[lead]) | (start != start[lead])
        return _batch([d[later], start[later] * 128 + 1, w[later]], ["doc", "at", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # runs whose anchor may go on in the next part
        for batch in batches:
            for g, doc, at, raw in _parts(batch):
                if held is not None:
                    g, doc, at = (np.concatenate([x, y]) for x, y in zip(held[:3], (g, doc, at), strict=True))
                    raw = held[3] + raw
                cut = int(np.searchsorted(g, g[-1]))
                if cut:
                    yield settle(g[:cut], doc[:cut], at[:cut], raw[:cut])
                held = (g[cut:], doc[cut:], at[cut:], raw[cut:])
        if held is not None:
            yield settle(*held)

    n = shuffle_partitions(runs.sparkSession)
    return runs.repartition(n, "g").sortWithinPartitions("g").mapInArrow(run, "doc long, at long, h long")


def _window_rows(runs: DataFrame, length: int, split) -> DataFrame:
    """Single windows of ``runs`` (g, doc, at, raw); ``at`` holds window * 128 + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                w, anchor, doc, start = _windows(*part, length)
                at = start * 128 + 1
                bucket = split.value.bucket(w, anchor, doc, at) if split else np.zeros(len(w), np.int32)
                yield _batch([bucket, w, anchor, doc, at], _ROW_NAMES)

    return runs.mapInArrow(run, ROW)


def _compare(rows: DataFrame, contest: bool) -> tuple[DataFrame, str]:
    """Sort each bucket and compare neighbours; the result and its folder.

    ``kind`` 0: a row that equals an earlier one (same g and h, larger (doc,
    start)).  1 (if ``contest``): the first of its class where its anchor has
    more classes, or may have beyond the bucket's border (``edge``, a sum: 1 it is
    the bucket's first anchor, 2 the last, 4 it has very many classes, 8 several).  2 and 3: the bucket's first row, and
    the first row of its last class.  4: the bucket's first row once more, to be
    removed if its class began before the bucket.
    """

    def settle(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        bucket, g, h, doc, at = cols
        n = len(g)
        new_g = np.empty(n, bool)
        new_g[0] = True
        new_g[1:] = g[1:] != g[:-1]
        new = new_g.copy()
        new[1:] |= h[1:] != h[:-1]
        first = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        lead = first[of]
        same_place = (doc == doc[lead]) & (at == at[lead])
        later = np.flatnonzero(~same_place)
        anchor = np.cumsum(new_g) - 1
        classes = np.bincount(anchor[first])
        kinds = [np.zeros(len(later), np.int8)]
        which = [later]
        edges = [np.zeros(len(later), np.int8)]
        if contest:
            many = classes[anchor[first]]
            edge = (anchor[first] == 0) * 1 + (anchor[first] == anchor[-1]) * 2 + (many > MOST_RUNS) * 4 + (many > 1) * 8
            take = edge > 0
            which.append(first[take])
            kinds.append(np.ones(int(take.sum()), np.int8))
            edges.append(edge[take].astype(np.int8))
        which.append(np.array([0, first[-1], *np.flatnonzero(same_place & (of == 0))]))
        kinds.append(np.array([2, 3, *[4] * int((same_place & (of == 0)).sum())], np.int8))
        edges.append(np.zeros(len(which[-1]), np.int8))
        k = np.concatenate(which)
        yield _batch(
            [bucket[k], g[k], h[k], doc[k], at[k], np.concatenate(kinds), np.concatenate(edges)],
            [*_ROW_NAMES, "kind", "edge"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # rows of the bucket being read
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(5)]
            cuts = [0, *(np.flatnonzero(np.diff(cols[0])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = [c[a:b] for c in cols]
                if held and b > a and held[0][0][0] != part[0][0]:
                    yield from settle([np.concatenate(c) for c in zip(*held, strict=True)])
                    held = []
                if b > a:
                    held.append(part)
        if held:
            yield from settle([np.concatenate(c) for c in zip(*held, strict=True)])

    n = shuffle_partitions(rows.sparkSession)
    dealt = rows.repartition(n, "bucket").sortWithinPartitions(*_ROW_NAMES)
    return stored(dealt.mapInArrow(run, ROW + ", kind byte, edge byte"), "suffix-compared")


def _borders(compared: DataFrame) -> DataFrame:
    """Per bucket what its neighbours say: ``before``, its first anchor began
    earlier; ``after``, its last anchor goes on; ``class_doc, class_at``, the
    first row of the class that it continues (null if it continues none).
    Read from two rows per bucket, whose number is set by the splitters."""
    rows = compared.filter("kind in (2, 3)").orderBy("bucket", "kind").collect()
    firsts = {r["bucket"]: r for r in rows if r["kind"] == 2}
    lasts = {r["bucket"]: r for r in rows if r["kind"] == 3}
    order, out, carried = sorted(firsts), [], None
    for k, b in enumerate(order):
        f, last = firsts[b], lasts[b]
        began = lasts[order[k - 1]] if k else None
        goes = firsts[order[k + 1]] if k + 1 < len(order) else None
        same = began is not None and (began["g"], began["h"]) == (f["g"], f["h"])
        lead = carried if same else (f["doc"], f["at"])
        out.append((
            b, began is not None and began["g"] == f["g"], goes is not None and goes["g"] == last["g"],
            lead[0] if same else None, lead[1] if same else None,
        ))
        carried = lead if (f["g"], f["h"]) == (last["g"], last["h"]) else (last["doc"], last["at"])
    spark = compared.sparkSession
    return spark.createDataFrame(out, "_bucket int, before boolean, after boolean, class_doc long, class_at long")


def _settled(compared: DataFrame) -> DataFrame:
    """``compared`` with each bucket's borders beside its rows."""
    return compared.join(F.broadcast(_borders(compared)), F.col("bucket") == F.col("_bucket"))


def _repeats(settled: DataFrame, bytes_hash: str) -> DataFrame:
    """(doc, at, h) of rows that equal an earlier one, also across buckets;
    ``bytes_hash``: the column with the hash of all bytes of the row."""
    elsewhere = (F.col("kind") == 4) & F.col("class_at").isNotNull() & (
        (F.col("doc") != F.col("class_doc")) | (F.col("at") != F.col("class_at"))
    )
    return settled.filter((F.col("kind") == 0) | elsewhere).select("doc", "at", F.col(bytes_hash).alias("h"))


def _sampled(docs: DataFrame) -> DataFrame:
    """At most SAMPLE_DOCS whole rows of ``docs``, the same ones every time."""
    low = bounded_sample(docs.select("doc").distinct(), "doc", SAMPLE_DOCS, 11)
    return docs.join(F.broadcast(low), "doc", "left_semi")


def _splitters(rows: DataFrame, buckets: int) -> Splitters:
    """Splitters from the rows of the sampled documents, 50,000 of them at most."""
    got = rows.select("g", "h", "doc", "at").orderBy(F.xxhash64("g", "doc", "at")).limit(50_000).toPandas()
    return Splitters(list(zip(*(got[c].tolist() for c in ("g", "h", "doc", "at")), strict=True)), buckets)


def repeated_windows(docs: DataFrame, length: int = 100) -> DataFrame:
    """``doc, at, h``: windows ``at >> 7`` to ``(at >> 7) + (at & 127) - 1`` of each
    document that also start earlier somewhere, and the hash of the bytes they
    cover.  ``docs``: ``doc`` (not null), ``text``.

    Each step is stored, and its shuffle files go with its end; of what is stored
    only the result stays.
    """
    if not 96 <= length <= 127:
        raise ValueError("length must be 96 to 127 bytes")
    spark = docs.sparkSession
    ship_package(spark)
    with shuffles_released(spark):
        return _repeated_windows(docs, length)


def _repeated_windows(docs: DataFrame, length: int) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    buckets = 4 * shuffle_partitions(spark)
    sample, sample_path = stored(_sampled(docs), "suffix-sample")
    split = sc.broadcast(_splitters(_run_rows(sample, length, None), buckets))
    compared, compared_path = _compare(_run_rows(docs, length, split), True)
    settled = _settled(compared)
    whole = _repeats(settled, "h")
    def flag(bit: int):
        return F.col("edge").bitwiseAND(F.lit(bit).cast("byte")) != 0

    beyond = (flag(1) & F.col("before")) | (flag(2) & F.col("after"))
    contested = settled.filter((F.col("kind") == 1) & (beyond | flag(8))).select(
        "doc", F.struct("at", F.col("g").alias("anchor"), (beyond | flag(4)).alias("wide")).alias("run")
    )
    by_doc = contested.groupBy("doc").agg(F.collect_set("run").alias("runs"))
    listed = docs.join(by_doc, "doc").select("doc", "text", "runs")
    contested, contested_path = stored(listed.mapInArrow(_run_bytes(length), RUN_BYTES), "suffix-runs")
    narrow = _met(contested.filter("not wide").select("g", "doc", "at", "raw"), length)
    wide = contested.filter("wide").select("g", "doc", "at", "raw")
    fine = sc.broadcast(_splitters(_window_rows(wide.join(sample.select("doc"), "doc", "left_semi"), length, None), buckets))
    windows, windows_path = _compare(_window_rows(wide, length, fine), False)
    single = _repeats(_settled(windows), "g")
    marks, _ = stored(whole.unionByName(narrow).unionByName(single), "suffix-marks")
    for path in (sample_path, compared_path, contested_path, windows_path):
        remove(spark, path)
    return marks


def _spans(at: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by the windows in ``at``."""
    if not len(at):
        return []
    first = at >> 7
    by = np.argsort(first, kind="stable")
    lo, hi = first[by], (first + (at & 127) - 1 + length)[by]
    top = np.maximum.accumulate(hi)
    new = np.append(True, lo[1:] > top[:-1])
    heads = np.flatnonzero(new)
    return list(zip(lo[heads].tolist(), top[np.append(heads[1:] - 1, len(lo) - 1)].tolist(), strict=True))


def _held(raw: bytes, at: np.ndarray, h: np.ndarray, length: int) -> np.ndarray:
    """Those of the marks ``at`` at whose place ``raw`` has the bytes hashed to
    ``h``; the others belong to another row of the same id."""
    first, size = at >> 7, (at & 127) - 1 + length
    ok = first + size <= len(raw)
    by = np.flatnonzero(ok)
    by = by[np.argsort(first[by], kind="stable")]
    cuts = np.searchsorted(first[by], np.arange(0, len(raw) + SLICE, SLICE))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        part, base = by[cuts[k] : cuts[k + 1]], k * SLICE
        h64 = _power_hashes(np.frombuffer(raw[base : base + SLICE + 2 * length], np.uint8))[64]
        ok[part] = _span_hash(h64, first[part] - base, size[part]).view(np.int64) == h[part]
    return at[ok]


def _marked(docs: DataFrame, length: int, text_col: str = "text") -> DataFrame:
    """``docs`` (doc, a text and others) with the array ``marks`` (null: none) of
    (at, h) of all rows of the id."""
    marks = repeated_windows(docs.select("doc", text_or_empty(text_col).alias("text")), length)
    by_doc = marks.groupBy("doc").agg(F.collect_set(F.struct("at", "h")).alias("marks"))
    return docs.join(by_doc, "doc", "left")


def removed_spans(docs: DataFrame, length: int = 100, text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``spans``,
    the maximal removed byte ranges (start, end)."""
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), order_id().alias("doc"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, marks in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                spans = []
                if marks.is_valid:
                    at, h = (marks.values.field(k).to_numpy() for k in range(2))
                    spans = _spans(_held(raw, at, h, length), length)
                kept = hashlib.sha256()
                at = 0
                for a, b in spans:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                out.append((len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), span), strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return _marked(slim, length).select("doc_id", "text", "marks").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    )


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``.

    A character of which only some bytes are removed goes as a whole.  ``n_chars``
    is counted anew where it is there.  A null text stays null.
    """
    # the whole row travels as one field, so no name of its columns can clash; the text is only there
    slim = docs.select(order_id().alias("doc"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))

    @F.pandas_udf("string")
    def cut(texts, places, hashes):
        import pandas as pd

        out = []
        for text, m, h in zip(texts, places, hashes, strict=True):
            if m is None:
                out.append(text)
                continue
            raw, at, kept = text.encode("utf-8", "surrogatepass"), 0, []
            for a, b in _spans(_held(raw, np.asarray(m, np.int64), np.asarray(h, np.int64), length), length):
                kept.append(raw[at:a])
                at = max(at, b)
            out.append(b"".join([*kept, raw[at:]]).decode("utf-8", "ignore"))
        return pd.Series(out)

    row = F.col("row")
    changed = F.col("marks").isNotNull() & row["text"].isNotNull()
    got = _marked(slim, length, "row.text").select(
        "row", changed.alias("changed"), F.when(changed, cut(text_or_empty("row.text"), "marks.at", "marks.h")).alias("cut")
    )
    new = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("cut").cast(docs.schema["n_chars"].dataType)
    return got.select(*[
        (F.when(F.col("changed"), new[c]).otherwise(row[c]) if c in new else row[c]).alias(c) for c in docs.columns
    ])


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
