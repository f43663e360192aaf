"""SentencePiece encoding (merge type) by backtracking, and decoding.

Exact merging gives the one sequence of pieces in which every two neighbours
are compatible: merged from their characters alone, the two come out as they
are.  (Merges run by score, then from the left; what happens left of a border
and right of it only meets in a merge across that border, so pairs decide.)
That sequence is found without merging whole words:

1. An Aho-Corasick automaton over the pieces gives the longest piece that
   starts at each place.
2. From the left, the longest piece is tried that is compatible with the piece
   before; else its longest beginning that is a piece, and so on.
3. Where none fits, the place is marked as failed in a bitfield and the piece
   before is shortened.  No place is left behind twice, so long words cost time
   in proportion to their length.

Compatibility is found by merging the two pieces' characters again; results are
remembered by pair.  Neighbouring characters that no piece holds side by side
are never merged, so texts are cut there first; characters that no piece holds
become bytes.

Whole texts are encoded; null counts as the empty text and has no ids.  Rows
are handled one by one: repeated rows and repeated or null ids give one result
row each, an empty table gives an empty result.  Only ``doc_id`` and the text
column are read, so other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from askwell.llm.chunks import Memo, byte_views, joined, slices
from askwell.llm.common import ship_package

#: stands for a space inside pieces (fixed value of the model format)
SPACE = "▁"
#: bytes of words, and pairs of pieces, remembered by a Python worker at most
MEMO_BYTES, MEMO_PAIRS = 96 << 20, 400_000


class PieceBPE:
    """Encoder and decoder for a merge-type model with byte fallback that has
    no normalisation rules and puts a space before each text."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        norm, train = model.normalizer_spec, model.trainer_spec
        if (
            train.model_type != train.BPE
            or not train.byte_fallback
            or train.treat_whitespace_as_suffix
            or norm.precompiled_charsmap
            or not norm.add_dummy_prefix
            or norm.remove_extra_whitespaces
            or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces)
        ):
            raise ValueError("a merge-type model with byte fallback and without normalisation is needed")
        self.piece = [p.piece for p in model.pieces]
        self.size = len(self.piece)
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.unknown = {i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN}
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == kinds.CONTROL}
        self.unknown_surface = train.unk_surface
        self.surface = ["" if i in self.silent else p.replace(SPACE, " ") for i, p in enumerate(self.piece)]
        self.byte_of = {i: int(p.piece[3:5], 16) for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        #: pieces with higher scores are merged first
        self.rank = {p: -model.pieces[i].score for p, i in self.id_of.items()}
        self.beside = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        self._number_pairs()

        whole = [p for p in self.id_of if len(p) == 1 or self.merged(p) == [p]]
        self.whole = set(whole)
        self.automaton = ahocorasick.Automaton()
        for p in whole:
            self.automaton.add_word(p, (self.id_of[p], len(p)))
        self.automaton.make_automaton()
        #: the longest proper beginning that is a piece, by id; -1 for none
        self.shorter = [-1] * self.size
        self.length = [0] * self.size
        for p in whole:
            i = self.id_of[p]
            self.length[i] = len(p)
            for k in range(len(p) - 1, 0, -1):
                if p[:k] in self.whole:
                    self.shorter[i] = self.id_of[p[:k]]
                    break
        self.pairs: dict[int, bool] = {}
        self.words = Memo(MEMO_BYTES)
        self.number = [str(i) for i in range(self.size)]

    def _number_pairs(self) -> None:
        """One bit for each two characters: whether some piece has them side by side."""
        chars = sorted(set("".join(self.beside)))
        self.width = len(chars) + 1  # number 0: characters that stand beside no other
        number = {c: k + 1 for k, c in enumerate(chars)}
        self.char_number = np.zeros(0x110000, np.uint16 if self.width < 1 << 16 else np.uint32)
        self.char_number[[ord(c) for c in chars]] = range(1, self.width)
        at = np.array([number[a] * self.width + number[b] for a, b in self.beside], np.int64)
        self.beside_bits = np.zeros(self.width * self.width // 8 + 1, np.uint8)
        np.bitwise_or.at(self.beside_bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    # -- exact merging, for pieces and pairs of pieces -------------------
    def merged(self, text: str) -> list[str]:
        """Best score first, then leftmost, until nothing merges."""
        parts, rank, never = list(text), self.rank.get, math.inf
        ranks = [rank(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != never:
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank(parts[k - 1] + parts[k], never)
            if k < len(ranks):
                ranks[k] = rank(parts[k] + parts[k + 1], never)
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether pieces ``a`` and ``b`` stay as they are side by side."""
        key = a * self.size + b
        fits = self.pairs.get(key)
        if fits is None:
            x, y = self.piece[a], self.piece[b]
            fits = x[-1] + y[0] not in self.beside or self.merged(x + y) == [x, y]
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            self.pairs[key] = fits
        return fits

    # -- words -----------------------------------------------------------
    def backtrack(self, word: str) -> list[int]:
        """Ids of a word whose neighbouring characters all stand in pieces."""
        n = len(word)
        longest = [0] * n
        for end, (i, size) in self.automaton.iter(word):
            longest[end - size + 1] = i  # later ends overwrite shorter pieces
        failed = bytearray(n // 8 + 1)
        length, shorter, pairs, size = self.length, self.shorter, self.pairs, self.size
        out: list[int] = []
        at, trial, last = 0, longest[0], -1
        while at < n:
            while trial >= 0:
                end = at + length[trial]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    fits = pairs.get(last * size + trial)
                    if fits or (fits is None and self.compatible(last, trial)):
                        break
                trial = shorter[trial]
            if trial >= 0:
                out.append(trial)
                at, last = end, trial
                trial = longest[at] if at < n else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                trial = out.pop()
                at -= length[trial]
                last = out[-1] if out else -1
        return out

    def _word(self, word: str) -> list[int]:
        if word in self.whole:
            return [self.id_of[word]]
        if len(word) == 1:
            return [self.id_of_byte[b] for b in word.encode("utf-8", "surrogatepass")]
        return self.backtrack(word)

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text."""
        if not text:
            return []
        out: list[int] = []
        text, start = SPACE + text.replace(" ", SPACE), 0
        for k in range(1, len(text)):
            if text[k - 1 : k + 1] not in self.beside:
                out += self._word(text[start:k])
                start = k
        return out + self._word(text[start:])

    # -- decoding --------------------------------------------------------
    def _from_bytes(self, run: bytes) -> str:
        """Bytes as text; each byte that begins no character becomes U+FFFD."""
        out, at = "", 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out += run[at : at + size].decode()
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out, size = out + "�", 1
            at += size
        return out

    def _surfaces(self, ids: list[int]) -> str:
        if self.byte_of.keys().isdisjoint(ids) and self.unknown.isdisjoint(ids):
            return "".join(map(self.surface.__getitem__, ids))
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(self._from_bytes(bytes(run)))
                run.clear()
            if i in self.unknown:
                out.append(self.unknown_surface)
            elif i >= 0 and i not in self.silent:
                out.append(self.surface[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, without the space that encoding put before it."""
        heard = next((i for i in ids if i not in self.silent), None)
        text = self._surfaces(ids)
        return text[1:] if heard is not None and self.piece[heard][0] == SPACE else text

    # -- batches ---------------------------------------------------------
    def _known(self, word: str) -> tuple[int, str, str]:
        """Number of ids, ids and text of a word."""
        got = self.words.get(word)
        if got is None:
            ids = self._word(word)
            got = (len(ids), ",".join(map(self.number.__getitem__, ids)), self._surfaces(ids))
            self.words.keep(word, got, 200 + len(got[1]) + 2 * len(word))
        return got

    def words_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Texts cut between characters that no piece holds side by side: word
        offsets by text, a number for each word, the distinct words by number."""
        texts = pc.fill_null(texts, "")
        led = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))
        led = pc.replace_substring(led, " ", SPACE).cast(pa.large_string())
        starts = np.zeros(len(led) + 1, np.int64)
        np.cumsum(pc.utf8_length(led).to_numpy(zero_copy_only=False), out=starts[1:])
        if not starts[-1]:
            return np.zeros(len(led) + 1, np.int64), np.zeros(0, np.int64), []
        first, last = np.frombuffer(led.buffers()[1], np.int64)[[led.offset, led.offset + len(led)]]
        data = led.buffers()[2][int(first) : int(last)]
        points = np.frombuffer(str(memoryview(data), "utf-8").encode("utf-32-le"), "<u4")
        number = self.char_number[points]
        pair = number[:-1].astype(np.int64) * self.width + number[1:]
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = self.beside_bits[pair >> 3] >> (pair & 7).astype(np.uint8) & 1 == 0
        cut[starts] = True
        at = np.flatnonzero(cut)
        ends = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000), out=ends[1:])
        words = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(ends[at]), data).dictionary_encode()
        return np.searchsorted(at, starts), words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_pylist()

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Number of ids, ids joined by commas, and a space and the decoded text
        (nothing where there are no ids), of each text."""
        self.words.make_room()
        offsets, codes, distinct = self.words_of(texts)
        known = [self._known(w) for w in distinct]
        ends = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(np.array([k[0] for k in known], np.int64)[codes], out=ends[1:])
        n = ends[offsets[1:]] - ends[offsets[:-1]]
        ids = joined(offsets, codes, [k[1] for k in known], ",")
        return n, ids, joined(offsets, codes, [k[2] for k in known], "")


_LOADED: dict[str, PieceBPE] = {}


def loaded(path: str) -> PieceBPE:
    """One encoder per model and Python worker; what it remembers lives on."""
    if path not in _LOADED:
        _LOADED[path] = PieceBPE(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode and decode every document.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if ``ids``,
    the ids and the decoded text themselves.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for at, size in slices(batch.column(1)):
                part = batch.slice(at, size)
                n, written, decoded = bpe.encode_texts(part.column(1))
                cols = {
                    "doc_id": part.column(0),
                    "n_tokens": pa.array(n),
                    "ids_sha256": pa.array([hashlib.sha256(v).hexdigest() for v in byte_views(written)], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(v[1:]).hexdigest() for v in byte_views(decoded)], pa.string()),
                }
                if ids:
                    cols["ids"] = pa.array([list(map(int, w.split(","))) if w else [] for w in written.to_pylist()], pa.list_(pa.int32()))
                    cols["decoded"] = pa.array([d[1:] for d in decoded.to_pylist()], pa.string())
                yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if ids:
        schema += ", ids array<int>, decoded string"
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return slim.mapInArrow(run, schema)


def op12_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
