"""WARC archives: index first, then coalesced byte-range reads.

``write_archives`` writes one gzip member per record, in page order, to files of
bounded size, and returns an index row per record: file, offset, length, URL,
digest.  Of records with equal payloads of at least ``min_bytes`` the one with
the smallest page id is the response; the others are revisits without payload.
``read_records`` takes any part of the index, sorts it by file and offset, and
reads neighbouring records by one byte range.

Files go to the shared folder through Arrow's file systems.  A task's attempt
writes files of its own name and only a finished attempt's index rows count, so
a lost executor leaves at worst files that no index row names.  The index is
stored before anything reads it.

Defined cases: null html is the empty payload; a null page id counts as larger
than every other and is left out of its record; rows with the smallest id of
their payload are all responses, so repeated rows each get a record; null URLs
are written as "urn:none"; an empty table gives an empty index; other columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.llm.common import materialize, order_id, scratch_path, ship_package, shuffle_partitions

FILE_BYTES = 256 << 20  # a file is closed once it holds as much
GAP_BYTES = 64 << 10  # unwanted bytes that are read rather than skipped
RANGE_BYTES = 8 << 20  # a range of several records holds at most as much
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
_INDEX_ARROW = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()),
    ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
])
_END = b"\r\n\r\n"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str, digest: str) -> bytes:
    """One record as it stands in the archive, not yet compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "urn:none")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {target} {digest}")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {date}", f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + _END + block + _END


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, rest = raw.partition(_END)
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(_END)[2]


def packed(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _with_roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Pages with ``refers_to`` (the response's id) and ``revisit``.

    Only ids and digests meet by digest; the html moves once, by page id.
    """
    slim = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
        F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"),
    )
    ids = slim.select(
        order_id("page_id").alias("_id"), F.col("page_id").alias("_page"), F.sha1(F.col("html").cast("binary")).alias("_sha"),
        F.octet_length("html").alias("_n"),
    ).filter(F.col("_n") >= min_bytes)
    first = ids.groupBy("_sha").agg(F.min("_page").alias("_first"), F.count(F.lit(1)).alias("_many")).filter("_many > 1").drop("_many")
    later = ids.join(first, "_sha").filter(F.col("_first").isNotNull() & ~F.col("_page").eqNullSafe(F.col("_first")))
    later = later.select("_id", "_sha", "_first").distinct()
    own = slim.withColumn("_own", order_id("page_id")).withColumn("_own_sha", F.sha1(F.col("html").cast("binary")))
    return own.join(later, (F.col("_own") == F.col("_id")) & (F.col("_own_sha") == F.col("_sha")), "left").select(
        "page_id", "url", F.when(F.col("_id").isNull(), F.lit(False)).otherwise(True).alias("revisit"),
        F.col("_first").alias("refers_to"), "html", F.col("_own").alias("_order"),
    )


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``; returns the stored index."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(folder)
        files.create_dir(base, recursive=True)
        task = TaskContext.get()
        number, out, at, name = 0, None, 0, ""
        try:
            for batch in batches:
                rows = []
                for page, url, revisit, first, html in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number}.warc.gz"
                        out, at, number = files.open_output_stream(f"{base}/{name}", compression=None), 0, number + 1
                    payload = html.encode("utf-8", "surrogatepass")
                    digest = digest_of(payload)
                    raw = packed(record(page, url, payload, first, revisit, date, digest), level)
                    out.write(raw)
                    rows.append((name, at, len(raw), url, digest, page, "revisit" if revisit else "response"))
                    at += len(raw)
                cols = list(zip(*rows, strict=True)) or [[]] * len(_INDEX_ARROW)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _INDEX_ARROW.types, strict=True)], schema=_INDEX_ARROW)
        finally:
            if out is not None:
                out.close()

    # the html stays in the partitions of the join, or of the input where that is a broadcast
    dealt = _with_roles(pages, min_bytes).sortWithinPartitions("_order").drop("_order")
    return materialize(dealt.select("page_id", "url", "revisit", "refers_to", "html").mapInArrow(run, INDEX), "warc-index")


def ranges(offsets: list[int], lengths: list[int]) -> list[list[int]]:
    """Groups of neighbouring records (by place in the sorted lists) read at once."""
    out: list[list[int]] = []
    begin = end = 0
    for k, (o, n) in enumerate(zip(offsets, lengths, strict=True)):
        if out and o - end <= GAP_BYTES and o + n - begin <= RANGE_BYTES:
            out[-1].append(k)
        else:
            out.append([k])
            begin = o
        end = max(end, o + n) if out[-1][0] != k else o + n
    return out


def read_records(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the
    selected records, and the payload itself if ``payloads`` (null for revisits).

    Payloads are digested again; a record that isn't what the index says is an error.
    """
    ship_package(index.sparkSession)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    if not payloads:
        names, types = names[:5], types[:5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(folder)
        source, opened = None, ""
        for batch in batches:
            name, offset, length, digest = (batch.column(k).to_pylist() for k in range(4))
            cuts = [k for k in range(len(name)) if not k or name[k] != name[k - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(name)], strict=True):
                if opened != name[a]:
                    source, opened = files.open_input_file(f"{base}/{name[a]}"), name[a]
                rows: list[tuple] = []
                for group in ranges(offset[a:b], length[a:b]):
                    low = offset[a + group[0]]
                    blob = source.read_at(max(offset[a + k] + length[a + k] for k in group) - low, low)
                    for k in group:
                        at = offset[a + k] - low
                        fields, payload = parse(zlib.decompress(blob[at : at + length[a + k]], 31))
                        revisit = fields["WARC-Type"] == "revisit"
                        said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        found = said if revisit else digest_of(payload)
                        if not said == found == digest[a + k]:
                            raise ValueError(f"{name[a]} at {offset[a + k]}: digest {found}, the index has {digest[a + k]}")
                        page, first = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                        rows.append((
                            None if page is None else int(page),
                            int(fields["X-Payload-Length"]) if revisit else len(payload),
                            found, fields["WARC-Type"], None if first is None else int(first), None if revisit else payload,
                        ))
                cols = list(zip(*rows, strict=True))[: len(names)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    n = shuffle_partitions(index.sparkSession)
    dealt = index.select("file", "offset", "length", "digest").repartition(n, "file").sortWithinPartitions("file", "offset")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return dealt.mapInArrow(run, schema + (", payload binary" if payloads else ""))


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_records(index, folder)
