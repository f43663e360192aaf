"""Secrets: base patterns, and a linear-chain conditional random field.

Base patterns find assignments of passwords and keys, access key ids and long
hex strings; their spans always stay.  The field then tags tokens (runs without
white space) as begin, inside or outside of a secret from their shape, their
neighbouring words and features of the whole text, and Viterbi decodes the best
tags.  Every token is scored, each different word of a batch once.  Tokens that no
run of tags can hold with a gain over outside (a bound by the scores of the tokens
round it and the greatest gain of a move) are outside in the best sequence and
needn't be decoded.  Tagged stretches that no base span touches are added under
the kind ``field``.

Weights are trained with an averaged perceptron on the tokens round base spans and
round other places of a bounded sample, each stretch once with all features and once
without those that restate the base patterns, so that shape and entropy have to tell
a secret by themselves.  Whole texts are searched; offsets are code points, end
exclusive.  Defined cases: null text counts as empty; null ids and repeated rows
get a row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.llm.common import ship_package

#: The kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex")
TRAIN_DOCS = 10_000  # rows that the field is trained on, at most
TRAIN_TOKENS = 200  # tokens of a row that it is trained on, at most
MISSED = 8.0  # margin, in weight, by which a secret's token has to beat outside in training
CONTEXT = 3  # tokens on either side that are trained on with a base span

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")
Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """By start, then kind as listed."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(n in low for n in _NAMES):
            out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# -- the field ----------------------------------------------------------

_TOKEN = re.compile(r"\S+")
_CUES = frozenset("password passwd pwd secret token key apikey api_key auth bearer credential private".split())
OUT, BEGIN, INSIDE = range(3)
_STRIP = "\"'.,;:!?()[]{}<>="


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def shape(s: str) -> str:
    """Classes of characters, runs shortened: "Ab12-x" gives "Aa9-a"."""
    out = []
    for c in s:
        k = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c if c in "=:\"'+/_-." else "?"
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def file_features(text: str) -> list[str]:
    """Of the whole text: is it like a configuration, does it hold code or prose."""
    lines = text.count("\n") + 1
    signs = text.count("=") + text.count("{") + text.count(";")
    out = ["file:signs" if signs > lines else "file:plain"]
    if "AKIA" in text or "BEGIN " in text:
        out.append("file:keys")
    return out


#: features that restate the base patterns: hidden in every second example
_TOLD = ("own", "cue", "before", "hex", "file:keys", "sign")
_CUE_AT = (-2, -1, 1)


def is_mixed(bare: str) -> bool:
    return any(c.isdigit() for c in bare) and any(c.isalpha() for c in bare)


def is_cue(w: str) -> bool:
    return w.strip(_STRIP).lower() in _CUES


def own_features(w: str) -> list[str]:
    """Of the word alone."""
    bare = w.strip(_STRIP)
    if bare.isalpha() and bare.islower():  # most words
        mixed, form, n_digits, upper = False, "a", 0, 0
    else:
        mixed, form = is_mixed(bare), shape(bare)
        n_digits, upper = sum(c.isdigit() for c in bare), sum(c.isupper() for c in bare)
    out = [
        "one", f"mixed:{mixed}", f"len:{min(len(bare) // 4, 8)}:{mixed}", f"bits:{int(entropy(bare) * 2)}:{mixed}",
        f"runs:{min(len(form), 12)}", f"classes:{''.join(sorted(set(form)))}", f"digits:{n_digits == len(bare)}",
        f"upper:{upper > 1 and upper == sum(c.isalpha() for c in bare)}",
    ]
    if len(bare) >= 16 and all(c in "0123456789abcdef" for c in bare):
        out.append("hex")
    if bare.lower() in _CUES or w.lower().startswith(_NAMES):
        out.append("own")
    if "=" in w or ":" in w:
        out.append("sign")
    return out


def token_features(words: list[str], k: int, file: list[str]) -> list[str]:
    out = own_features(words[k])
    out += [f"cue{d}" for d in _CUE_AT if 0 <= k + d < len(words) and is_cue(words[k + d])]
    if k and words[k - 1] in ("=", ":"):
        out.append("before")
    mixed = is_mixed(words[k].strip(_STRIP))
    return out + [f"{f}:{mixed}" for f in file]


class Field:
    def __init__(self, weights: dict[str, list[float]], moves: list[list[float]]):
        self.weights, self.moves = weights, moves

    def decode(self, feats: list[list[str]], gold: list[int] | None = None) -> list[int]:
        """The best tags; with ``gold`` those that are best when wrong tags have a
        bonus, ``MISSED`` where a secret's token is called outside."""
        none, scores = (0.0, 0.0, 0.0), []
        for k, fs in enumerate(feats):
            ws = [self.weights.get(f, none) for f in fs]
            scores.append([sum(w[t] for w in ws) for t in range(3)])
            for t in range(3) if gold else ():
                if t != gold[k]:
                    scores[k][t] += MISSED if t == OUT else 1.0
        return self.best(scores, False, False)

    def best(self, scores: list[list[float]], out_before: bool, out_after: bool) -> list[int]:
        """Viterbi: the best tags; inside can't follow outside or the start.  The
        tokens before and after are outside, or there are none."""
        moves = self.moves
        best, back = [0.0, 0.0, -math.inf], []
        for k, score in enumerate(scores):
            if not k:
                enter = moves[OUT] if out_before else (0.0, 0.0, 0.0)
                best = [score[0] + enter[0], score[1] + enter[1], -math.inf]
                back.append([0, 0, 0])
                continue
            new, came = [], []
            for t in range(3):
                opts = [best[p] + moves[p][t] for p in range(3)]
                if t == INSIDE:
                    opts[OUT] = -math.inf
                p = max(range(3), key=opts.__getitem__)
                new.append(opts[p] + score[t])
                came.append(p)
            best = new
            back.append(came)
        if out_after:
            best = [b + moves[t][OUT] for t, b in enumerate(best)]
        t = max(range(3), key=best.__getitem__) if scores else 0
        tags = []
        for came in reversed(back):
            tags.append(t)
            t = came[t]
        return tags[::-1]


class _Ids(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = n = len(self)
        return n


class Words:
    """Scores of each different word of a batch of texts, made once."""

    def __init__(self, field: Field):
        self.field, self.ids, self.known = field, _Ids(), 0
        self.own, self.flags = np.zeros((0, 3)), np.zeros((0, 3), bool)
        # the most that a move into, inside or out of a run gains over staying outside
        m = field.moves
        self.gain = max(0.0, *(m[p][q] - m[OUT][OUT] for p in range(3) for q in range(3) if (p, q) != (OUT, OUT)))

    def _weight(self, features: list[str]) -> list[float]:
        ws = [w for w in map(self.field.weights.get, features) if w is not None]
        return [sum(w[t] for w in ws) for t in range(3)]

    def scores(self, text: str, words: list[str]) -> np.ndarray:
        """(tokens, 3): the same sums as those of ``token_features``."""
        ids = self.ids
        at = np.array([ids[w] for w in words], np.int64)
        if len(ids) > self.known:
            new, ids.fresh = ids.fresh, []
            a, b = self.known, len(ids)
            if b > len(self.own):  # room for twice as many
                self.own = np.concatenate([self.own[:a], np.zeros((2 * b - a, 3))])
                self.flags = np.concatenate([self.flags[:a], np.zeros((2 * b - a, 3), bool)])
            self.own[a:b] = [self._weight(own_features(w)) for w in new]
            self.flags[a:b] = [(is_cue(w), w in ("=", ":"), is_mixed(w.strip(_STRIP))) for w in new]
            self.known = b
        out = self.own[at]
        cue, sign, mixed = self.flags[at].T
        for d in _CUE_AT:
            has = np.zeros(len(at), bool)
            if d < 0:
                has[-d:] = cue[:d]
            else:
                has[:-d] = cue[d:]
            out[has] += self._weight([f"cue{d}"])
        after = np.zeros(len(at), bool)
        after[1:] = sign[:-1]
        out[after] += self._weight(["before"])
        file = file_features(text)
        for flag in (False, True):
            out[mixed == flag] += self._weight([f"{f}:{flag}" for f in file])
        return out

    def tags(self, text: str, words: list[str]) -> list[tuple[int, list[int]]]:
        """(first token, its tags) of each stretch that can hold anything but outside."""
        score = self.scores(text, words)
        c = score[:, 1:].max(1) - score[:, OUT] + self.gain
        if not len(c) or (c < -self.gain).all():
            return []
        # the best sum of c over runs that hold the token, from both sides
        best = _reach(c) + _reach(c[::-1])[::-1] - c
        held = np.flatnonzero(best + self.gain >= -1e-6)
        out = []
        for run in np.split(held, np.flatnonzero(np.diff(held) > 1) + 1):
            if len(run):
                a, b = int(run[0]), int(run[-1]) + 1
                out.append((a, self.field.best(score[a:b].tolist(), a > 0, b < len(words))))
        return out


def _reach(c: np.ndarray) -> np.ndarray:
    """For each place the greatest sum of a run that ends there."""
    out, done = c.copy(), -1
    for p in np.flatnonzero(c > 0).tolist():
        if p <= done:
            continue
        carry, k = out[p], p + 1
        while carry > 0 and k < len(c):
            carry = out[k] = c[k] + carry
            k += 1
        done = k - 1
    return out


def gold_tags(tokens: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    out, before = [], None
    for a, b in tokens:
        hit = next((s for s in spans if s[0] < b and a < s[1]), None)
        out.append(OUT if hit is None else INSIDE if before is not None and before[0] <= hit[0] < before[1] else BEGIN)
        before = hit
    return out


def stretches(text: str, spans: list[Span]) -> Iterator[list[tuple[int, int]]]:
    """Tokens to train on: those round base spans, and as many plain ones from a
    place that the text's digest gives; ``TRAIN_TOKENS`` in all at most."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts = [a for a, _ in tokens]
    low, high, left = 0, 0, TRAIN_TOKENS
    for a, b, _ in spans:
        first, last = bisect.bisect_right(starts, a) - 1 - CONTEXT, bisect.bisect_left(starts, b) + CONTEXT
        if first > high or last - low > left:
            if high:
                yield tokens[low:high]
                left -= high - low
            low = max(first, high, 0)
        high = min(max(last, high), low + left)
        if left <= 0:
            return
    if high > low:
        yield tokens[low:high]
        left -= high - low
    if tokens and left > 0:
        at = zlib.crc32(text.encode("utf-8", "replace")) % len(tokens)
        plain = tokens[at : at + min(left, 4 * CONTEXT)]
        if gold_tags(plain, spans).count(OUT) == len(plain):
            yield plain


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        feats, tags = [], []
        for text in batch.column(0).to_pylist():
            spans, file = base_spans(text), file_features(text)
            for tokens in stretches(text, spans):
                words = [text[a:b] for a, b in tokens]
                every = [token_features(words, k, file) for k in range(len(words))]
                gold = gold_tags(tokens, spans)
                feats.append(every)
                tags.append(gold)
                if any(gold):
                    feats.append([[f for f in fs if not f.startswith(_TOLD)] for fs in every])
                    tags.append(gold)
        yield pa.RecordBatch.from_arrays(
            [pa.array(feats, pa.list_(pa.list_(pa.string()))), pa.array(tags, pa.list_(pa.int32()))], ["feats", "tags"]
        )


def train(docs: DataFrame, rounds: int = 5) -> Field:
    # a bound on hashes of id and text, then on rows: copies of one row share a hash
    keyed = docs.select("text", F.xxhash64("doc_id", "text", F.lit(13)).alias("h"))
    last = keyed.select("h").distinct().orderBy("h").limit(TRAIN_DOCS).agg(F.max("h"))
    drawn = keyed.filter(F.col("h") <= last.scalar()).dropDuplicates(["h"])
    rows = drawn.select("text").mapInArrow(_examples, "feats array<array<string>>, tags array<int>")
    data = [([[sys.intern(f) for f in fs] for fs in r["feats"]], list(r["tags"])) for r in rows.collect()]  # stretches of a bounded sample
    data.sort(key=lambda d: (d[1], d[0]))
    weights: dict[str, list[float]] = defaultdict(lambda: [0.0] * 3)
    total: dict[str, list[float]] = defaultdict(lambda: [0.0] * 3)
    moves, total_moves = [[0.0] * 3 for _ in range(3)], [[0.0] * 3 for _ in range(3)]
    step = 1
    for r in range(rounds):
        for d in range(len(data)):
            feats, gold = data[(d * 7919 + r) % len(data)]
            got = Field(weights, moves).decode(feats, gold)
            if got != gold:
                for k, (g, h) in enumerate(zip(gold, got, strict=True)):
                    if g != h:
                        for f in feats[k]:
                            for t, x in ((g, 1.0), (h, -1.0)):
                                weights[f][t] += x
                                total[f][t] += step * x
                    if k:
                        for p, q, x in ((gold[k - 1], g, 1.0), (got[k - 1], h, -1.0)):
                            moves[p][q] += x
                            total_moves[p][q] += step * x
            step += 1
    # averages over all steps
    mean = {f: [w - total[f][t] / step for t, w in enumerate(ws)] for f, ws in weights.items()}
    return Field(mean, [[moves[p][q] - total_moves[p][q] / step for q in range(3)] for p in range(3)])


def find(text: str, words_of: Words) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, of one text."""
    base = base_spans(text)
    more: list[Span] = []
    found = words_of.tags(text, text.split())
    if any(any(tags) for _, tags in found):
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        for first, tags in found:
            run: list[tuple[int, int]] = []
            for tok, tag in [*zip(tokens[first:], tags), ((0, 0), OUT)]:
                if tag != INSIDE and run:
                    a, b = run[0][0], run[-1][1]
                    if not _touches(base, a, b):
                        while a < b and text[a] in _STRIP:
                            a += 1
                        while b > a and text[b - 1] in _STRIP:
                            b -= 1
                        if a < b:
                            more.append((a, b, "field"))
                    run = []
                if tag != OUT:
                    run.append(tok)
    order = [*KINDS, "field"]
    return base, sorted(base + more, key=lambda s: (s[0], order.index(s[2])))


def _touches(spans: list[Span], a: int, b: int) -> bool:
    return any(s[0] < b and a < s[1] for s in spans)


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for every row."""
    ship_package(docs.sparkSession)
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    field = train(slim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_of = Words(field)
            got = [find(t, words_of) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *(pa.array([sum(s[2] == k for s in b) for b, _ in got], pa.int64()) for k in KINDS),
                    pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in got], pa.string()),
                    pa.array([written(e) for _, e in got], pa.string()),
                ],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return slim.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
