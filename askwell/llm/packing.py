"""Hierarchical best-fit packing of tokenised documents into sequences.

1. Each input partition tokenises its documents, cuts only those that are
   longer than a sequence (the first piece takes the remainder), and packs the
   pieces best-fit, longest first.  Nearly full bins are final.
2. Underfull bins become items of their own and are merged in rounds: each
   round deals at most ``bins_per_task`` of them to a task and packs those
   best-fit again.  Rounds end when one task has seen all that is left, or no
   bin was saved.
3. Pieces take the sequence and the shifted offset of the bin they ended in.

Only (bin, fill) pairs move between tasks in 2.; texts and ids never do.

A null or empty text has the closing token alone.  A repeated row is packed
once per row.  An empty table gives an empty result.  Columns besides
``doc_id`` and the text are not read, so their names may clash with anything.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from askwell.llm.bpe import _UNCOMMON as UNCOMMON
from askwell.llm.bpe import byte_symbols
from askwell.llm.chunks import Memo, gather, numbered, slices
from askwell.llm.common import materialize, ship_package

#: Fixed value: the splitting rule of byte-level files.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White_Space of Unicode, as a class of Arrow's expressions
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: characters that only Python counts as white space
_PYTHON_SPACE = "[\x1c-\x1f]"
#: white space, then what follows it
_RUNS = re.compile(r"\s*\S+|\s+")
#: bytes of chunks remembered by a Python worker at most
MEMO_BYTES = 96 << 20
PIECE_SCHEMA = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, bin_offset long, fill int"
)


class DocumentTokens:
    """Token ids of texts by a byte-level file of the tokenizers library.

    The file's splitting rule never joins a character other than white space
    with white space that follows it, and looks no further back than the start
    of a run of white space.  So texts are cut before each run, and each
    distinct chunk is encoded once.

    A chunk's key is what follows a single space, or "\\x1c" and the chunk
    itself.  Chunks of common characters, whose classes no Unicode version
    changes, are merged by tiktoken: where tokens are numbered in the order of
    the rules that make them, merging by number and by rule is the same.  All
    others are encoded by the tokenizers library, and so are whole texts with
    added tokens.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.whole = "|".join([_PYTHON_SPACE, *(re.escape(a) for a in self.added)])
        self.common = self._common_encoder(path)
        if self.common:
            values = self.common.token_byte_values()
            self.n_bytes = np.zeros(self.common.max_token_value + 1, np.int64)
            self.n_bytes[[self.common.encode_single_token(v) for v in values]] = list(map(len, values))
        self.memo = Memo(MEMO_BYTES)

    @staticmethod
    def _common_encoder(path: str):
        """Encoder of chunks of common characters; None where numbers don't
        follow the rules or the file asks for anything else."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        plain = (
            split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
            and spec["normalizer"] is None
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        )
        made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if not plain or made != list(range(256, 256 + len(made))):
            return None
        of = {c: b for b, c in enumerate(byte_symbols())}
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
        return tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _by_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _in_one_text(self, keys: list[str]) -> list[bytes]:
        """Ids of chunks of common characters that end in no white space: one
        text of all of them is encoded and cut where their bytes end."""
        text = " " + " ".join(keys)
        ids = self.common.encode_to_numpy(text)
        ends = np.cumsum(np.fromiter((len(k.encode()) for k in keys), np.int64, len(keys)) + 1)
        at = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends, "left") + 1
        raw, bounds = ids.astype("<u4").tobytes(), [0, *(4 * at).tolist()]
        return [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _known(self, keys: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each chunk."""
        memo = self.memo
        missing = [k for k in keys if k not in memo]
        found: dict[str, bytes] = {}
        joinable = [k for k in missing if k and k[0] != "\x1c" and not k[-1].isspace()] if self.common else []
        if joinable and UNCOMMON.search("".join(joinable)):
            joinable = [k for k in joinable if not UNCOMMON.search(k)]
        for at in range(0, len(joinable), 50_000):
            some = joinable[at : at + 50_000]
            found.update(zip(some, self._in_one_text(some), strict=True))
        single = [k for k in missing if k not in found]
        found.update(zip(single, self._by_library([k[1:] if k[:1] == "\x1c" else " " + k for k in single]), strict=True))
        out = [memo[k] if k in memo else found[k] for k in keys]
        for k, ids in found.items():
            memo.keep(k, ids, 40 + len(ids))
        return out

    def _own_keys(self, text: str) -> list[str]:
        """Keys of a text (it has "\\x1c" before it) in which spaces meet other white space."""
        out = []
        for c in _RUNS.findall(text[1:]):
            single = c[0] == " " and len(c) > 1 and not c[1].isspace()
            out.append(c[1:] if single else "\x1c" + c)
        return out

    def of(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, ``end_id`` after each, and where each text ends."""
        self.memo.make_room()
        texts = pc.fill_null(texts, "")
        # a key that holds a whole text may hold anything
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        texts = pc.binary_join_element_wise("\x1c", texts, "")
        special = whole | pc.match_substring_regex(texts, f" {_SPACE}|{_SPACE} ").to_numpy(zero_copy_only=False)
        wholes = set(texts.filter(pa.array(whole)).to_pylist())
        offsets, codes, keys = numbered(texts, special, lambda t: ["\x1c" + t] if t in wholes else self._own_keys(t))
        known = [
            self._by_library([k[2:]])[0] if k[:2] == "\x1c\x1c" else None for k in keys
        ]
        rest = iter(self._known([k for k, ids in zip(keys, known, strict=True) if ids is None]))
        known = [next(rest) if ids is None else ids for ids in known]
        known.append(np.array([end_id], "<u4").tobytes())
        codes = np.insert(codes, offsets[1:], len(keys))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        counts = sizes[codes]
        ids = np.frombuffer(b"".join(known), "<u4")[gather((np.cumsum(sizes) - sizes)[codes], counts)]
        return ids, np.cumsum(counts)[offsets[1:] + np.arange(len(texts))]


_LOADED: dict[str, DocumentTokens] = {}


def tokens(path: str) -> DocumentTokens:
    if path not in _LOADED:
        _LOADED[path] = DocumentTokens(path)
    return _LOADED[path]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: bin and offset of each item, and the bins' fills.

    Open bins are kept by the room they have left, with one bit per amount of
    room, so the tightest bin that takes an item is one bit operation away.
    """
    bins = np.zeros(len(sizes), np.int64)
    offsets = np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fitting = rooms >> size
        if fitting:
            room = size + ((fitting & -fitting).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[k], offsets[k] = b, fills[b]
        fills[b] += size
        room -= size
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins, offsets, fills


def cut(ids: np.ndarray, ends: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Pieces of texts: text, piece, start, length and checksum of each.  Only
    texts longer than ``capacity`` are cut; their first piece takes the rest."""
    sizes = np.diff(ends, prepend=0)
    n = np.maximum(1, -(-sizes // capacity))
    text = np.repeat(np.arange(len(sizes)), n)
    piece = gather(np.zeros(len(n), np.int64), n)
    first = (sizes - (n - 1) * capacity)[text]
    start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
    length = np.where(piece == 0, first, capacity)
    at = (ends - sizes)[text] + start
    raw = memoryview(ids.tobytes())
    crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
    return text, piece, start, length, np.array(crc, np.int64)


def _pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens(path)
        doc, parts = [pa.array([], pa.int64())], [np.zeros((4, 0), np.int64)]
        for batch in batches:
            for at, size in slices(batch.column(1)):
                part = batch.slice(at, size)
                text, *numbers = cut(*encoder.of(part.column(1), end_id), capacity)
                doc.append(part.column(0).take(pa.array(text)))
                parts.append(np.stack(numbers))
        piece, start, length, crc = np.concatenate(parts, axis=1)
        bins, offsets, fills = best_fit(length, capacity)
        base = TaskContext.get().partitionId() << 40  # the same when a lost task runs again
        fill = np.array(fills, np.int32)[bins] if len(bins) else np.zeros(0, np.int32)
        cols = [
            pa.concat_arrays(doc), pa.array(piece.astype(np.int32)), pa.array(start),
            pa.array(length), pa.array(crc), pa.array(bins + base), pa.array(offsets), pa.array(fill),
        ]
        names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
        whole = pa.RecordBatch.from_arrays(cols, names)
        for at in range(0, whole.num_rows, 50_000):
            yield whole.slice(at, 50_000)

    return docs.mapInArrow(run, PIECE_SCHEMA)


def _merge_round(bins: DataFrame, tasks: int, salt: int, capacity: int) -> DataFrame:
    """(bin, fill) -> (bin, parent, shift, parent_fill), packed per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema([("bin", pa.int64()), ("fill", pa.int32())]))
        own = table.column(0).to_numpy()
        sizes = table.column(1).to_numpy().astype(np.int64)
        by = np.argsort(own)
        own, sizes = own[by], sizes[by]
        into, offsets, fills = best_fit(sizes, capacity)
        parent = np.zeros(len(fills), np.int64)
        parent[into[offsets == 0]] = own[offsets == 0]  # a bin keeps the id of the first one in it
        yield pa.RecordBatch.from_arrays(
            [pa.array(own), pa.array(parent[into] if len(own) else own), pa.array(offsets),
             pa.array(np.array(fills, np.int32)[into] if len(own) else np.zeros(0, np.int32))],
            ["bin", "parent", "shift", "parent_fill"],
        )

    dealt = bins.select("bin", "fill").repartition(tasks, F.xxhash64("bin", F.lit(salt)))
    return dealt.mapInArrow(run, "bin long, parent long, shift long, parent_fill int")


def pack(
    docs: DataFrame,
    path: str,
    capacity: int = 2048,
    end_id: int = 0,
    nearly_full: int = 16,
    bins_per_task: int = 100_000,
    text_col: str = "text",
) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    A bin with at most ``nearly_full`` tokens of room is final at once.  Returns
    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    """
    spark = docs.sparkSession
    ship_package(spark)
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    pieces = materialize(_pieces(slim, path, capacity, end_id), "pack-pieces")

    # one row per underfull bin: its first piece stands for it
    state = materialize(
        pieces.filter((F.col("fill") < capacity - nearly_full) & (F.col("bin_offset") == 0)).select(
            "bin", F.col("bin").alias("cur"), F.lit(0).cast("long").alias("shift"), "fill",
            F.lit(True).alias("open"),
        ),
        "pack-bins",
    )
    n_open, salt = state.count(), 0
    while n_open > 1:
        salt += 1
        tasks = -(-n_open // bins_per_task)
        now = state.filter("open").select(F.col("cur").alias("bin"), "fill").distinct()
        step = _merge_round(now, tasks, salt, capacity).withColumnRenamed("bin", "_cur").withColumnRenamed("shift", "_by")
        moved = state.join(step, F.col("cur") == F.col("_cur"), "left").select(
            "bin",
            F.coalesce("parent", "cur").alias("cur"),
            (F.col("shift") + F.coalesce("_by", F.lit(0))).alias("shift"),
            F.coalesce("parent_fill", "fill").alias("fill"),
            (F.col("open") & (F.coalesce("parent_fill", "fill") < capacity - nearly_full)).alias("open"),
        )
        state = materialize(moved, f"pack-round{salt}")
        left = state.filter("open").agg(F.countDistinct("cur")).first()[0]
        if tasks == 1 or left >= n_open:
            break
        n_open = left
    ends = state.filter((F.col("bin") != F.col("cur")) | (F.col("shift") != 0)).select(
        F.col("bin").alias("_bin"), "cur", "shift"
    )
    return pieces.join(ends, F.col("bin") == F.col("_bin"), "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("cur", "bin").alias("sequence_id"),
        (F.col("bin_offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its pieces in order and its fill."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length"))).alias("pieces"),
    )


def check_gapless(packed: DataFrame) -> DataFrame:
    """Rows of ``packed`` whose offset isn't the end of the piece before."""
    w = Window.partitionBy("sequence_id").orderBy("offset")
    ends = F.lag(F.col("offset") + F.col("length"), 1, 0).over(w)
    return packed.withColumn("_due", ends).filter("offset != _due").drop("_due")


def op1_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
