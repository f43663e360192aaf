"""Toxicity scores from a learned lexicon with misspellings and context.

1. Lexicon: word beginnings (and whole words) that are far more frequent in toxic
   training documents than in others, grown to their longest common form.  A
   term is either a whole word or a stem, and weighs the more the purer it is.
   Near copies among the training documents count once.
2. Matching: each distinct word runs through a Levenshtein automaton that is
   intersected with the trie of the lexicon.  Stems match as beginnings.  Stems
   and whole words match misspelled, too: terms of at least ``FUZZY_LENGTH``
   letters with one edit, of at least ``FAR_LENGTH`` with two (a swap of two
   neighbours is one).  Forms that clean training texts hold too often to tell
   anything don't match, and a term loses a number of edits with which rare
   forms (under three uses) alone match in more than ``NOISE`` of the clean texts.
3. Context: a match within a quotation, or shortly after a word that reports
   speech, counts as quoted, any other as abuse.
4. Score: logistic regression on counts of exact, misspelled and quoted matches
   and the share of words that match.

Labels are read only of rows whose CRC-32 of the id modulo 5 isn't 0, and at most
``train_docs`` of them train the lexicon and the regression (a bounded sample,
the same every time).  Labels, language, source and id are no inputs of a score.
Every word of every text is scored.

Defined cases: null text counts as empty and scores as a text without a match;
without any training rows all scores are 0.5 or the base rate; null ids are not
held out; repeated rows each get a row; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.llm.common import bounded_sample, ship_package

CACHE_ENTRIES = 500_000  # words remembered by a Python worker at most
MIN_STEM, MAX_STEM = 3, 12
FUZZY_LENGTH = 4  # terms at least this long match with one edit
FAR_LENGTH = 8  # terms at least this long match with two, if learned
NOISE = 0.001  # share of clean texts that a term may match in with so many edits
NEAR_RATIO = 4.0  # near forms less often toxic than that, for the words read, don't match
WINDOW = 6  # words before a match that may mark it as reported
#: Word forms that report somebody else's words.
REPORTING = frozenset("said says say called calls wrote writes quote quoted quoting word words term dit dice sagte sagt schrieb".split())
_WORD = re.compile(r"\w+")
_QUOTES = "\"'“”„«»‘’"


@dataclass
class Lexicon:
    stems: dict[str, float] = field(default_factory=dict)  # weights from 0 to 1
    words: dict[str, float] = field(default_factory=dict)
    clean: frozenset[str] = frozenset()  # forms near a term that clean documents hold too often
    far: int | None = None  # length from which two edits match; None: one at most
    fewer: dict[str, int] = field(default_factory=dict)  # edits of terms that have less than their length allows

    def __post_init__(self):
        # trie: vertex -> {letter: vertex}; what ends there
        self.step: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[str, float]] = {}
        for kind, terms in (("stem", self.stems), ("word", self.words)):
            for t, weight in terms.items():
                at = 0
                for c in t:
                    if c not in self.step[at]:
                        self.step.append({})
                        self.step[at][c] = len(self.step) - 1
                    at = self.step[at][c]
                self.ends[at] = (kind, weight)
        # edits that the terms below each vertex allow at most
        self.most = [0] * len(self.step)
        self.term: dict[int, str] = {}
        for t in [*self.stems, *self.words]:
            at = 0
            for c in ["", *t]:
                at = self.step[at][c] if c else 0
                self.most[at] = max(self.most[at], self.edits(t))
            self.term[at] = t
        self.begun: dict[str, tuple] = {}  # states after beginnings of words
        self.firsts = frozenset(t[0] for t in [*self.stems, *self.words])

    def exact(self, word: str) -> float:
        """Weight of the term that ``word`` is, or begins with; 0 if none."""
        at = 0
        for k, c in enumerate(word):
            at = self.step[at].get(c, -1)
            if at < 0:
                return 0.0
            if at in self.ends:
                kind, weight = self.ends[at]
                if kind == "stem" or k == len(word) - 1:
                    return weight
        return 0.0

    def edits(self, term: str) -> int:
        """Edits that a term matches with at most."""
        by_length = 2 if self.far and len(term) >= self.far else 1 if len(term) >= FUZZY_LENGTH else 0
        return min(by_length, self.fewer.get(term, by_length))

    def _state(self, live: dict[int, int], swaps: frozenset) -> tuple[dict[int, int], frozenset, dict[int, int]]:
        """Adds what letters missing in the word lead to; and the stems reached."""
        todo = list(live.items())
        while todo:
            v, e = todo.pop()
            for u in self.step[v].values():
                if e < self.most[u] and e + 1 < live.get(u, 9):
                    live[u] = e + 1
                    todo.append((u, e + 1))
        return live, swaps, self._ended(live, "stem")

    def _ended(self, live: dict[int, int], kind: str) -> dict[int, int]:
        return {v: e for v, e in live.items() if v in self.ends and self.ends[v][0] == kind and e <= self.edits(self.term[v])}

    def _read(self, live: dict[int, int], swaps: frozenset, c: str) -> tuple[dict[int, int], frozenset, dict[int, int]]:
        """The state after one more letter of the word."""
        new: dict[int, int] = {}

        def put(v: int, e: int) -> None:
            if e <= self.most[v] and e < new.get(v, 9):
                new[v] = e

        held = set()
        for v, e in live.items():
            put(v, e + 1)  # a letter too many
            for x, u in self.step[v].items():
                put(u, e + (x != c))
                # x and c change places: c is read now, x must be next
                to = self.step[u].get(c, -1)
                if x != c and to >= 0 and e < self.most[to]:
                    held.add((to, e + 1, x))
        for v, e, x in swaps:
            if x == c:
                put(v, e)
        return self._state(new, frozenset(held))

    def hits(self, word: str) -> dict[int, int]:
        """Ends of the whole words near ``word``, and of the stems near a beginning
        of it, with the fewest edits.

        The automaton's state is the trie's vertices with the fewest edits that
        lead to them, and swaps of which one letter is read.
        """
        if "" not in self.begun:
            self.begun[""] = self._state({0: 0}, frozenset())
        live, swaps, _ = self.begun[""]
        out: dict[int, int] = {}
        for k, c in enumerate(word):
            begin = word[: k + 1]
            if k < 4 and begin in self.begun:
                live, swaps, found = self.begun[begin]
            else:
                live, swaps, found = self._read(live, swaps, c)
                if k < 4:
                    if len(self.begun) > CACHE_ENTRIES // 10:
                        self.begun = {"": self.begun[""]}
                    self.begun[begin] = live, swaps, found
            for v, e in found.items():
                out[v] = min(e, out.get(v, 9))
            if not live and not swaps:
                return out
        return out | self._ended(live, "word")

    def near(self, word: str) -> float:
        return max((self.ends[v][1] for v in self.hits(word)), default=0.0)

    def match(self, word: str) -> tuple[float, float]:
        """Weights of an exact and of a misspelled match."""
        if word[0] in self.firsts and (w := self.exact(word)):
            return w, 0.0
        if len(word) >= FUZZY_LENGTH - 1:
            return 0.0, 0.0 if word in self.clean else self.near(word)
        return 0.0, 0.0


class Matcher:
    """A lexicon with a memory of the words it has met."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.known: dict[str, tuple[int, float, float]] = {}

    def chunk(self, chunk: str) -> tuple[int, float, float]:
        """Of a run without white space: its words, and the weights of their matches."""
        words = _WORD.findall(chunk)
        got = [self.lexicon.match(w) for w in words]
        return len(words), sum(a for a, _ in got), sum(b for _, b in got)

    def features(self, text: str) -> list[float]:
        """Weights of abuse (exact, misspelled) and of quoted matches, and the number of words."""
        chunks = text.lower().split()
        known = self.known
        for c in set(chunks):
            if c not in known:
                known[c] = self.chunk(c)
        found = list(map(known.__getitem__, chunks))
        exact = near = quoted = 0.0
        for k, (_, a, b) in enumerate(found):
            if a or b:
                if self.quoted(chunks, k):
                    quoted += a + b
                else:
                    exact += a
                    near += b
        if len(known) > CACHE_ENTRIES:
            known.clear()
        return [exact, near, quoted, sum([f[0] for f in found])]

    @staticmethod
    def quoted(chunks: list[str], k: int) -> bool:
        """Whether the match stands in quotation marks or is reported."""
        before = chunks[max(0, k - WINDOW) : k + 1]
        opened = sum(c[0] in _QUOTES for c in before) - sum(c[-1] in _QUOTES or c[-2:-1] in _QUOTES for c in before[:-1])
        if opened > 0 and any(c.rstrip(".,;:!?")[-1:] in _QUOTES for c in chunks[k : k + WINDOW]):
            return True
        return any(c.strip(".,;:!?") in REPORTING for c in before[:-1])


def inputs(features: np.ndarray) -> np.ndarray:
    """Regression inputs from the counts."""
    exact, near, quoted, words = features.T
    share = 100 * (exact + 0.5 * near) / np.maximum(words, 1)
    pure = exact >= 0.9
    return np.column_stack([pure, near > 0, quoted > 0, np.log1p(exact), np.log1p(near), np.log1p(share), np.ones(len(words))])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; the constant isn't penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn_lexicon(rows: DataFrame, n_toxic: int, ratio: float = 8.0) -> Lexicon:
    """From ``rows`` (text, toxic): terms at least ``ratio`` times as frequent in
    toxic documents, held by at least 3 of them and 1.5 %."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen: Counter[str] = Counter()
                for w, many in Counter(_WORD.findall(text.lower())).items():
                    seen[""] += many
                    for m in range(MIN_STEM, min(MAX_STEM, len(w)) + 1):
                        seen[w[:m]] += many
                    seen["=" + w] += many
                for t, many in seen.items():
                    d = terms.setdefault(t, [0, 0, 0])
                    d[0] += bool(toxic)
                    d[1 if toxic else 2] += many
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(terms)), *(pa.array([d[k] for d in terms.values()], pa.int64()) for k in range(3))],
                ["term", "docs", "uses", "clean"],
            )

    counted = rows.mapInArrow(run, "term string, docs long, uses long, clean long").groupBy("term").agg(
        *(F.sum(c).alias(c) for c in ("docs", "uses", "clean"))
    )
    held = counted.filter(F.col("docs") >= max(3, round(0.015 * n_toxic)))
    # as frequent as that in a bounded sample: few terms
    picked = held.filter("term = ''").collect()
    if not picked:
        return Lexicon()
    words_toxic, words_clean = picked[0]["uses"], max(picked[0]["clean"], 1)
    odds = (F.col("uses") / words_toxic) / ((F.col("clean") + 0.5) / words_clean)
    found = held.filter((odds >= ratio) & (F.col("term") != "")).select("term", "uses", odds.alias("odds")).orderBy(F.desc("uses"), "term").limit(20_000).collect()
    uses = {r["term"]: r["uses"] for r in found}
    weight = {r["term"]: min(1.0, float(np.log(r["odds"]) / np.log(100))) for r in found}
    stems, words = {}, {}
    for t in sorted((t for t in uses if t[0] != "="), key=lambda t: (len(t), t)):
        if any(t[:m] in uses for m in range(MIN_STEM, len(t))):
            continue  # a shorter one stands for it
        while len(t) < MAX_STEM:  # grow it while one continuation has nearly all its uses
            longer = [u for u in uses if len(u) == len(t) + 1 and u.startswith(t) and uses[u] >= 0.95 * uses[t]]
            if not longer:
                break
            t = longer[0]
        if uses.get("=" + t, 0) >= 0.95 * uses[t]:
            words[t] = weight[t]
        else:
            stems[t] = weight[t]
    # whole words that no stem stands for
    for t in uses:
        if t[0] == "=" and not any(t[1 : 1 + m] in uses for m in range(MIN_STEM, len(t))):
            words[t[1:]] = weight[t]
    return Lexicon(stems, words, far=FAR_LENGTH)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the smallest hash of their word triples: near copies mostly share it."""
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            w = text.lower().split()
            out.append(min(zlib.crc32(" ".join(w[k : k + 3]).encode("utf-8", "replace")) for k in range(max(1, len(w) - 2))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["text", "toxic", "sketch"])


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``text, toxic`` of at most ``most`` labelled rows that aren't held out."""
    fit = labels.select(labels["doc_id"].cast("long").alias("_id"), labels["toxic"].cast("int").alias("toxic")).filter(
        F.col("_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("_id").cast("string")) % 5 != 0)
    )
    fit = bounded_sample(fit.groupBy("_id").agg(F.max("toxic").alias("toxic")), "_id", most, 3)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(fit), F.col("doc_id") == F.col("_id")).select("text", "toxic")  # bounded by ``most``
    sketched = rows.mapInArrow(_sketched, "text string, toxic int, sketch long")
    return sketched.groupBy("sketch", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, train_docs: int = 8_000) -> tuple[Lexicon, np.ndarray]:
    from askwell.llm.common import materialize

    spark = docs.sparkSession
    ship_package(spark)
    rows = materialize(training_rows(docs, labels, train_docs), "toxicity-train")
    seen = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = seen.get(1, 0), seen.get(0, 0)
    if not n_toxic or not n_clean:
        rate = 0.5 if not seen else (0.99 if n_toxic else 0.01)
        return Lexicon(), np.array([0, 0, 0, 0, 0, 0, np.log(rate / (1 - rate))])
    lexicon = learn_lexicon(rows, n_toxic)

    def near_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = Matcher(lexicon)
            uses: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, many in Counter(_WORD.findall(text.lower())).items():
                    uses.setdefault(w, [0, 0, 0])[1 if toxic else 2] += many
            for w, u in uses.items():
                u[0] = int(m.lexicon.match(w)[1] > 0)
            uses[""] = [1, sum(u[1] for u in uses.values()), sum(u[2] for u in uses.values())]
            out = sorted(w for w, u in uses.items() if u[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.string()), *(pa.array([uses[w][k] for w in out], pa.int64()) for k in (1, 2))],
                ["form", "toxic", "clean"],
            )

    # forms near a term, of a bounded sample; the empty one stands for all words
    forms = rows.mapInArrow(near_forms, "form string, toxic long, clean long").groupBy("form").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )
    total = forms.filter("form = ''").first()
    odds = ((F.col("toxic") + 0.5) / max(total["toxic"], 1)) / ((F.col("clean") + 0.5) / max(total["clean"], 1))
    common = forms.filter((F.col("form") != "") & (odds < NEAR_RATIO)).select("form").collect()
    lexicon = Lexicon(lexicon.stems, lexicon.words, frozenset(r["form"] for r in common), lexicon.far)

    # rare forms tell how many others to expect in texts that weren't read
    often = frozenset(r["form"] for r in forms.filter("form != '' and clean >= 3").select("form").collect())

    def near_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs: Counter[tuple[str, int]] = Counter()
            for text in batch.column(0).to_pylist():
                words = {w for w in _WORD.findall(text.lower()) if w not in often and not lexicon.exact(w)}
                best: dict[str, int] = {}
                for w in words:
                    for v, e in lexicon.hits(w).items():
                        best[lexicon.term[v]] = min(e, best.get(lexicon.term[v], 9))
                docs.update(best.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in docs], pa.string()), pa.array([e for _, e in docs], pa.int32()), pa.array(list(docs.values()), pa.int64())],
                ["term", "edits", "docs"],
            )

    # clean texts by term and edits: a row or two a term
    noise = rows.filter("toxic = 0").select("text").mapInArrow(near_terms, "term string, edits int, docs long").groupBy("term", "edits").agg(F.sum("docs").alias("docs"))
    seen_near = {(r["term"], r["edits"]): r["docs"] for r in noise.collect()}
    most = max(1, NOISE * n_clean)
    fewer = {}
    for t in [*lexicon.stems, *lexicon.words]:
        e = lexicon.edits(t)
        while e and sum(seen_near.get((t, k), 0) for k in range(1, e + 1)) > most:
            e -= 1
        fewer[t] = e
    lexicon = Lexicon(lexicon.stems, lexicon.words, lexicon.clean, lexicon.far, fewer)
    got = rows.select("text", "toxic").mapInArrow(_feature_rows(lexicon), FEATURES).toPandas()
    x = got[["exact", "near", "quoted", "words"]].to_numpy(float)
    y = got["label"].to_numpy(float)
    # A misspelled match tells no less than the prior says: two pseudo-documents.
    extra = np.array([[0, 1, 0, 100], [0, 2, 0, 100], [0, 0, 1, 100], [0, 0, 2, 100]], float)
    w = fit_logistic(np.vstack([inputs(x), inputs(extra)]), np.append(y, [1, 1, 0, 0]))
    return lexicon, w


FEATURES = "label int, exact double, near double, quoted double, words double"


def _feature_rows(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(lexicon)
        for batch in batches:
            got = np.array([m.features(t) for t in batch.column(0).to_pylist()], np.float64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).cast(pa.int32()), *(pa.array(got[:, k]) for k in range(4))],
                [c.split()[0] for c in FEATURES.split(", ")],
            )

    return run


def score(docs: DataFrame, model: tuple[Lexicon, np.ndarray], text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the weights found, for every row."""
    ship_package(docs.sparkSession)
    lexicon, w = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(lexicon)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = np.array([m.features(t or "") for t in part.column(1).to_pylist()], np.float64).reshape(-1, 4)
                p = 1 / (1 + np.exp(-np.clip(inputs(got) @ w, -30, 30)))
                out = [d is not None and zlib.crc32(str(d).encode()) % 5 == 0 for d in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(out), pa.array(p), pa.array((p >= 0.5).astype(np.int32)),
                     *(pa.array(got[:, k]) for k in range(3))],
                    ["doc_id", "held_out", "score", "predicted", "exact", "misspelled", "quoted"],
                )

    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return slim.mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int, exact double, misspelled double, quoted double"
    )


def without_toxic(docs: DataFrame, labels: DataFrame, train_docs: int = 8_000) -> DataFrame:
    """Rows of ``docs`` whose score is under 0.5, whole and in their partitions."""
    lexicon, w = train(docs, labels, train_docs)

    @F.pandas_udf("boolean")
    def clean(texts):
        import pandas as pd

        m = Matcher(lexicon)
        got = np.array([m.features(t or "") for t in texts], np.float64).reshape(-1, 4)
        return pd.Series(inputs(got) @ w < 0)

    return docs.filter(clean(docs["text"].cast("string")))


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
