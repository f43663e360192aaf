"""Personal data: base patterns, and a skip-chain conditional random field.

Base patterns find e-mail and IP addresses, card and phone numbers; their spans
always stay.  The field then labels candidate tokens (those with a digit or an
@) as one of the kinds or as none.  Its potentials: token features (shape, what
the base patterns say, neighbouring words), a chain potential between
neighbouring candidates, and a skip potential between each candidate and the
next one that has the same letters and digits, however distant.  Loopy
sum-product message passing over chain and skip edges makes a document's
labels agree; a token that is labelled as a kind without a base span is added.

Skip edges join an occurrence to the next one only, so edges grow with the
tokens, not with their square.  Weights are trained on the base spans of a
bounded sample of documents by pseudo-likelihood, with the base evidence of a
token hidden half of the time, so that the field learns to tell a kind from
shape, neighbours and repetitions.

Whole texts are searched.  Offsets are code points, end exclusive.  Defined cases:
null text counts as empty; null ids and repeated rows get a row each; an empty
table gives an empty result; other columns are not read.  All patterns run in
linear time on long runs of one character class.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.llm.common import bounded_sample, ship_package

#: The kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS = 10_000  # documents that the field is trained on, at most

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @: as far left as the pattern's characters go, but not into the match before."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    if _DIGIT.search(text) is None:
        return out
    if "." in text:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15]
    return out


def written(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


# -- the field ----------------------------------------------------------

#: candidates: runs without white space that hold a digit or an @, without the punctuation round them
_CANDIDATE = re.compile(r"(?<!\S)\S*[0-9@]\S*")
_EDGE = ".,;:!?\"'()[]{}<>"
_LABELS = len(KINDS) + 1  # 0: none
_CUES = {
    "email": "mail email e-mail contact courriel correo",
    "ip": "ip host address server client addr",
    "card": "card visa credit carte tarjeta karte iban payment",
    "phone": "phone tel call mobile fax telefon téléphone teléfono",
}
_CUE_OF = {w: k for k, ws in _CUES.items() for w in ws.split()}
_FEATURES = 24


class Token:
    __slots__ = ("end", "key", "start", "text", "x")

    def __init__(self, text: str, start: int, end: int):
        self.start, self.end = start, end
        self.text = text[start:end]
        self.key = "".join(c for c in self.text.lower() if c.isalnum())


def tokens_of(text: str) -> list[Token]:
    out = []
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if b - a >= 4:
            t = Token(text, a, b)
            before = re.findall(r"\w[\w-]*", text[max(0, a - 40) : a].lower())[-3:]
            t.x = _features(t, [_CUE_OF[w.strip("-")] for w in before if w.strip("-") in _CUE_OF])
            out.append(t)
    return out


def _features(t: Token, cues: list[str]) -> np.ndarray:
    s = t.text
    digits = sum(c.isdigit() for c in s)
    x = np.zeros(_FEATURES)
    x[0] = 1
    x[1] = "@" in s
    x[2] = "@" in s and "." in s.rpartition("@")[2]
    x[3] = digits == len(s)
    x[4] = s.count(".") == 3 and digits + 3 == len(s)
    x[5] = digits == 16
    x[6] = 17 <= digits <= 19
    x[7] = 8 <= digits <= 15
    x[8] = s[0] == "+"
    x[9] = digits < 8 and x[4] == 0
    x[10] = any(c.isalpha() for c in s)
    x[11] = "-" in s or "(" in s
    x[12] = 16 <= digits <= 19 and _luhn("".join(c for c in s if c in "0123456789")) if digits else 0
    for c in cues:
        x[13 + KINDS.index(c)] = 1
    return x  # 17 to 20: base evidence; 21 to 23 are spare


def base_labels(tokens: list[Token], spans: dict[str, list[tuple[int, int]]]) -> list[int]:
    out = []
    for t in tokens:
        label = 0
        for k, kind in enumerate(KINDS):
            if any(a < t.end and t.start < b for a, b in spans[kind]):
                label = k + 1
                break
        out.append(label)
    return out


def edges_of(tokens: list[Token]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between close neighbours, skip edges to the next equal token."""
    chain = [(k, k + 1) for k in range(len(tokens) - 1) if tokens[k + 1].start - tokens[k].end <= 20]
    last: dict[str, int] = {}
    skip = []
    for k, t in enumerate(tokens):
        if len(t.key) >= 6:
            if t.key in last:
                skip.append((last[t.key], k))
            last[t.key] = k
    return chain, skip


def marginals(unary: np.ndarray, edges: list[tuple[int, int]], kinds: list[int], pair: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Loopy sum-product, damped, all messages of a round at once."""
    if not edges:
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    e = np.array(edges)
    src, dst = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
    back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
    table = np.concatenate([pair[kinds], pair[kinds].transpose(0, 2, 1)])
    msg = np.zeros((len(src), _LABELS))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        cavity = belief[src] - msg[back]
        new = np.logaddexp.reduce(cavity[:, :, None] + table, axis=1)
        new -= new.max(1, keepdims=True)
        if np.abs(new - msg).max() < 1e-4:
            break
        msg = 0.3 * msg + 0.7 * new
    belief = unary.copy()
    np.add.at(belief, dst, msg)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Field:
    def __init__(self, w: np.ndarray, pair: np.ndarray):
        self.w, self.pair = w, pair

    def labels(self, tokens: list[Token], base: list[int]) -> list[int]:
        x = np.stack([t.x for t in tokens])
        for k, b in enumerate(base):
            if b:
                x[k, 16 + b] = 1
        chain, skip = edges_of(tokens)
        p = marginals(x @ self.w, chain + skip, [0] * len(chain) + [1] * len(skip), self.pair)
        best = p.argmax(1)
        return [int(b) if p[k, b] >= 0.9 else 0 for k, b in enumerate(best)]


def train(docs: DataFrame) -> Field:
    """Pseudo-likelihood on the base spans of a bounded sample of documents that
    hold candidates."""
    # ids first: texts of the drawn documents stay where they are
    ids = bounded_sample(docs.select("doc_id").distinct(), "doc_id", TRAIN_DOCS, 9)
    drawn = docs.join(F.broadcast(ids), "doc_id", "left_semi").filter(F.col("text").rlike("[0-9@]")).select("doc_id", "text")
    rows = drawn.mapInArrow(_training_rows, "x array<double>, y int, chain array<double>, skip array<double>").toPandas()
    if rows.empty:
        return Field(np.zeros((_FEATURES, _LABELS)), np.zeros((2, _LABELS, _LABELS)))
    x, y = np.stack(rows["x"].to_numpy()), rows["y"].to_numpy()
    # neighbours' labels, counted by kind of edge, are inputs with tied weights
    near = np.stack([np.stack(rows["chain"].to_numpy()), np.stack(rows["skip"].to_numpy())], 1)
    w, pair = np.zeros((_FEATURES, _LABELS)), np.zeros((2, _LABELS, _LABELS))
    target = np.eye(_LABELS)[y]
    for _ in range(300):
        z = x @ w + np.einsum("nkl,klm->nm", near, pair)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= 2.0 * (x.T @ (p - target) / len(x) + 2e-4 * w)
        step = np.einsum("nkl,nm->klm", near, p - target) / len(x)
        pair -= 2.0 * ((step + step.transpose(0, 2, 1)) / 2 + 2e-4 * pair)
    return Field(w, pair)


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens = tokens_of(text)
            base = base_labels(tokens, base_spans(text))
            chain, skip = edges_of(tokens)
            near = np.zeros((2, len(tokens), _LABELS))
            for kind, edges in enumerate((chain, skip)):
                for a, b in edges:
                    near[kind, a, base[b]] += 1
                    near[kind, b, base[a]] += 1
            for k, t in enumerate(tokens):
                x = t.x.copy()
                if base[k] and hash((doc or 0, k)) % 2:
                    x[16 + base[k]] = 1
                out.append((x.tolist(), base[k], near[0, k].tolist(), near[1, k].tolist()))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        wide = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (wide, pa.int32(), wide, wide), strict=True)], ["x", "y", "chain", "skip"]
        )


def find(text: str, field: Field) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans and all spans of one text."""
    base = base_spans(text)
    every = {k: list(v) for k, v in base.items()}
    if "@" in text or _DIGIT.search(text):
        tokens = tokens_of(text)
        if tokens:
            said = base_labels(tokens, base)
            for t, own, got in zip(tokens, said, field.labels(tokens, said), strict=True):
                if got and not own:
                    every[KINDS[got - 1]].append((t.start, t.end))
    return base, every


def _slim(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row."""
    ship_package(docs.sparkSession)
    slim = _slim(docs, text_col)
    field = train(slim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [find(t, field) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), *(pa.array([len(b[k]) for b, _ in got], pa.int64()) for k in KINDS),
                    pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in got], pa.string()),
                    pa.array([written(e) for _, e in got], pa.string()),
                ],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return slim.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """``text`` with each span replaced by its kind; where spans overlap, the
    first one's kind stands for all of them."""
    found = sorted((a, b, k) for k in KINDS for a, b in spans[k])
    out, at = [], 0
    for a, b, k in found:
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def without_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind, ``n_chars`` counted
    anew where it is there.  A null text stays null."""
    ship_package(docs.sparkSession)
    field = train(_slim(docs, "text"))
    names = docs.columns

    @F.pandas_udf("string")
    def mask(texts):
        import pandas as pd

        return pd.Series([None if t is None else masked(t, find(t, field)[1]) for t in texts], dtype=object)

    got = docs.withColumn("text", mask(docs["text"].cast("string")))
    if "n_chars" in names:
        got = got.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return got.select(*names)


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
