"""BPE encoding and decoding by proposal and verification.

For each word a greedy longest match over the vocabulary proposes tokens.  A
proposal equals the exact BPE result iff every two neighbouring tokens are
compatible, i.e. no merge would cross the border between them; that check runs
in numpy over all distinct neighbouring pairs of a batch at once.  Only words
with an incompatible pair are merged exactly, rule by rule.

Whole texts are encoded (null counts as the empty text: no tokens).  A very
long word costs time in proportion to its length (times a logarithm where it
must be merged exactly).  Rows are handled one by one: repeated rows and
repeated ids give one result row each, an empty table gives an empty result.
Only ``doc_id`` and the text column are read, so other columns don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: words and chunks remembered by a Python worker at most
CACHE_ENTRIES = 600_000
_NEVER = np.int64(2**40)

#: Fixed value: the vocabulary's splitting rule, for chunks without white space.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+"
#: Characters other than those whose class, case and white space are the same in every Unicode version.
_UNCOMMON = re.compile(
    "[^\t-\r -~\x85\xa0-ɏΑ-ΡΣ-ωА-я‐-‧‰-›€"
    "ぁ-ゖァ-ヺ一-龥가-힣]"
)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1
    bytes stand for themselves, the others take the code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class WordBPE:
    """Encoder and decoder for a word-end BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab.update(self.special)
        self.size = max(self.vocab.values()) + 1
        self.token = [""] * self.size
        for t, i in self.vocab.items():
            self.token[i] = t
        self.symbol = byte_symbols()
        self.inner = [self.vocab[c] for c in self.symbol]
        self.final = [self.vocab[c + self.suffix] for c in self.symbol]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if not isinstance(m, str) else m.split(" ")
            self.merge[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        # one number per rule: its rank, then the token it makes
        self.packed = {p: r * self.size + t for p, (r, t) in self.merge.items()}
        self.never = (len(model["merges"]) + 1) * self.size
        ordinary = [t for t in model["vocab"] if t not in self.special]
        self.longest = max(len(t.removesuffix(self.suffix)) for t in ordinary)
        self._spines(ordinary)
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words_re = regex.compile(_WORDS)
        self.number = [str(i) for i in range(self.size)]
        #: length of the longest entry by its first two symbols
        self.reach: dict[str, int] = {}
        for t in ordinary:
            body = t.removesuffix(self.suffix)
            self.reach[body[:2]] = max(self.reach.get(body[:2], 0), len(body))
        self.dtype = "<u2" if self.size <= 1 << 16 else "<u4"
        self.chunks: dict[str, bytes] = {}
        #: splits texts with characters that Unicode versions treat differently
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)

    # -- exact merging -------------------------------------------------
    def merged(self, ids: list[int]) -> tuple[list[int], tuple[int, int, int] | None]:
        """The exact BPE result, and (left, right, rank) of the last merge."""
        last = None
        if len(ids) <= 64:
            ids, get, never, size = list(ids), self.packed.get, self.never, self.size
            ranks = [get(p, never) for p in zip(ids, ids[1:], strict=False)]
            while ranks and (best := min(ranks)) != never:
                k = ranks.index(best)
                last = (ids[k], ids[k + 1], best // size)
                ids[k : k + 2] = [best % size]
                del ranks[k]
                if k:
                    ranks[k - 1] = get((ids[k - 1], ids[k]), never)
                if k < len(ranks):
                    ranks[k] = get((ids[k], ids[k + 1]), never)
            return ids, last
        # long words: a heap of possible merges over a linked list
        n = len(ids)
        ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.merge[p][0], k, *p) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merge]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            nxt = after[k]
            if ids[k] != a or nxt >= n or ids[nxt] != b:
                continue
            last = (a, b, rank)
            ids[k], ids[nxt] = self.merge[a, b][1], -1
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n:
                    p = (ids[left], ids[after[left]])
                    if p in self.merge:
                        heapq.heappush(heap, (self.merge[p][0], left, *p))
        return [i for i in ids if i >= 0], last

    def exact(self, word: str) -> list[int]:
        """Ids of a word given in symbols, merged rule by rule."""
        return self.merged([self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.suffix]])[0]

    # -- compatibility of neighbours -----------------------------------
    def _spines(self, ordinary: list[str]) -> None:
        """For each token the tokens that cover its last (first) symbol while it
        is being merged, with the rank that ends each of them."""
        self.whole = np.zeros(self.size, bool)
        parts: dict[int, tuple[int, int, int]] = {}
        stands_for = {c: b for b, c in enumerate(self.symbol)}
        for t in ordinary:
            ends = t.endswith(self.suffix)
            body = t.removesuffix(self.suffix) if ends else t
            if not body or any(c not in stands_for for c in body):
                continue
            ids = [self.inner[stands_for[c]] for c in body]
            if ends:
                ids[-1] = self.final[stands_for[body[-1]]]
            out, last = self.merged(ids)
            self.whole[self.vocab[t]] = out == [self.vocab[t]]
            if self.whole[self.vocab[t]] and last:
                parts[self.vocab[t]] = last

        def spine(side: int) -> tuple[np.ndarray, np.ndarray]:
            chains: dict[int, list[tuple[int, int]]] = {}

            def of(t: int) -> list[tuple[int, int]]:
                if t not in chains:
                    if t in parts:
                        below = of(parts[t][side])
                        chains[t] = [*below[:-1], (below[-1][0], parts[t][2]), (t, int(_NEVER))]
                    else:
                        chains[t] = [(t, int(_NEVER))]
                return chains[t]

            for t in np.flatnonzero(self.whole):
                of(int(t))
            deep = max(map(len, chains.values()))
            who = np.full((self.size, deep), -1, np.int64)
            end = np.full((self.size, deep), _NEVER, np.int64)
            for t, c in chains.items():
                who[t, : len(c)] = [x for x, _ in c]
                end[t, : len(c)] = [r for _, r in c]
            return who, end

        self.last_of, self.last_end = spine(1)
        self.first_of, self.first_end = spine(0)
        keys = np.array([a * self.size + b for a, b in self.merge], np.int64)
        ranks = np.array([r for r, _ in self.merge.values()], np.int64)
        by = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[by], ranks[by]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border of each pair (a, b).

        Both sides are walked through their states in the order of the merges.
        A crossing merge happens if its rank comes before the left side's next
        merge and not after the right side's (equal rules run left to right).
        """
        good = self.whole[a] & self.whole[b]
        todo = np.flatnonzero(good)
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(todo):
            x, y, p, q = a[todo], b[todo], i[todo], j[todo]
            left, right = self.last_end[x, p], self.first_end[y, q]
            rank = self._rank(self.last_of[x, p], self.first_of[y, q])
            crosses = (rank < left) & (rank <= right) & (rank < _NEVER)
            good[todo[crosses]] = False
            step_left = left <= right
            more = ~crosses & ((left < _NEVER) | (right < _NEVER))
            i[todo[more & step_left]] += 1
            j[todo[more & ~step_left]] += 1
            todo = todo[more]
        return good

    # -- words, chunks and texts ---------------------------------------
    def greedy(self, word: str) -> list[int]:
        """Of a word in symbols: longest vocabulary entry from the left, again and again."""
        s = word
        vocab, suffix, reach, n, out, i = self.vocab, self.suffix, self.reach, len(s), [], 0
        while i < n:
            j = i + reach.get(s[i : i + 2], 1)
            if j >= n:
                t = vocab.get(s[i:] + suffix)
                if t is not None:
                    out.append(t)
                    break
                j = n - 1 if n - i > 1 else n
            while (t := vocab.get(s[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word: propose, verify all pairs at once, mend."""
        out = [self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter(chain.from_iterable(out), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(out)), sizes)
        inside = owner[1:] == owner[:-1]
        pair = (flat[:-1] * self.size + flat[1:])[inside]
        which, back = np.unique(pair, return_inverse=True)
        fits = self.compatible(which // self.size, which % self.size)[back]
        failing = np.union1d(owner[1:][inside][~fits], owner[~self.whole[flat]])
        for k in failing:
            out[k] = self.exact(words[k])
        return out

    def _symbols_of(self, word: str) -> str:
        if word.isascii():
            return word  # words hold printable ASCII or one of the escapes below
        return "".join([self.symbol[b] for b in word.encode("utf-8", "surrogatepass")])

    def _learn(self, missing: list[str], split: list[list[str]]) -> None:
        """Encode chunks not met before; ``split`` has the words of each."""
        words = list(dict.fromkeys(chain.from_iterable(split)))
        ids = dict(zip(words, self.encode_words(words), strict=True)) if words else {}
        for c, ws in zip(missing, split, strict=True):
            flat = ids[ws[0]] if len(ws) == 1 else list(chain.from_iterable([ids[w] for w in ws]))
            self.chunks[c] = np.array(flat, self.dtype).tobytes()

    def _chunks_of(self, text: str) -> list[str]:
        """Runs without white space, normalised as the file says."""
        if _UNCOMMON.search(text):
            # the library's own tables decide; "\0" marks words already in symbols
            normal = self.lib.normalizer.normalize_str(text)
            return ["\0" + w for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(normal)]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # no final sigma
                return ["".join([c.lower() for c in p]) for p in text.split()]
        return text.lower().split()

    def _words_of(self, chunk: str) -> list[str]:
        if chunk[0] == "\0":
            return [chunk[1:]]
        return [self._symbols_of(w) for w in self.words_re.findall(chunk)]

    def encode_texts(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text."""
        if len(self.chunks) > CACHE_ENTRIES:
            self.chunks.clear()
        for t, i in self.special.items():
            self.chunks["\1" + t] = np.array([i], self.dtype).tobytes()
        per_text: list[list[str]] = []
        for text in texts:
            text = text or ""
            if "<|" in text and self.special_re and self.special_re.search(text):
                parts: list[str] = []
                for k, seg in enumerate(self.special_re.split(text)):
                    parts += ["\1" + seg] if k % 2 else self._chunks_of(seg)
                per_text.append(parts)
            else:
                per_text.append(self._chunks_of(text))
        missing = [c for c in set(chain.from_iterable(per_text)) if c not in self.chunks]
        if missing:
            self._learn(missing, [self._words_of(c) for c in missing])
        get = self.chunks.__getitem__
        return [np.frombuffer(b"".join(map(get, parts)), self.dtype).tolist() for parts in per_text]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_texts([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens joined by a space."""
        return " ".join(map(self.token.__getitem__, ids))

    def written(self, ids: list[int]) -> str:
        return " ".join(map(self.number.__getitem__, ids))


_LOADED: dict[str, WordBPE] = {}


def loaded(path: str) -> WordBPE:
    """One encoder per vocabulary and Python worker; its cache lives on."""
    if path not in _LOADED:
        _LOADED[path] = WordBPE(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", ids: bool = False) -> DataFrame:
    """Encode and decode every document.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if ``ids``,
    the token ids and the decoded text themselves.
    """
    from askwell.llm.common import ship_package

    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = bpe.encode_texts(part.column(1).to_pylist())
                decoded = [bpe.decode(g) for g in got]
                cols = {
                    "doc_id": part.column(0),
                    "n_tokens": pa.array(list(map(len, got)), pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(bpe.written(g).encode()).hexdigest() for g in got], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                }
                if ids:
                    cols["ids"] = pa.array(got, pa.list_(pa.int32()))
                    cols["decoded"] = pa.array(decoded, pa.string())
                yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if ids:
        schema += ", ids array<int>, decoded string"
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return slim.mapInArrow(run, schema)


def op2_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
