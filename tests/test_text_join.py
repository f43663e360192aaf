"""Joins of texts in units: packed rows, best partners, and a greedy pass over texts near one another."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from askwell.operators import text_join
from askwell.operators import text_similarity as TS
from tests.test_similarity_dedup import _py_cos, sequential_greedy


def test_packed_terms_come_back():
    ranked, rank = np.array([-5, 7, 2**62]), np.array([2, 0, 1], np.int32)
    terms = np.array([7, 7, 2**62, 9, -(2**63), 9, 9], np.int64)
    ranks, others, counts = text_join.unpack(text_join.pack(terms, ranked, rank))
    assert ranks.tolist() == [0, 1] and others.tolist() == [-(2**63), 9] and counts.tolist() == [2, 1, 1, 3]
    ranks, others, counts = text_join.unpack(text_join.pack(np.array([4, 4]), np.zeros(0, np.int64), np.zeros(0, np.int32)))
    assert ranks.tolist() == [] and others.tolist() == [4] and counts.tolist() == [2]


def _near_texts(rnd, near, others):
    """Texts of which ``near`` all lie close together, some exact copies, and others."""
    words = [f"w{i}" for i in range(30)]
    long = [rnd.choice(words) for _ in range(400)]
    docs = []
    for _ in range(near):
        t = list(long)
        for _ in range(rnd.randrange(12)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        docs.append(" ".join(t))
    docs += [" ".join(rnd.choice(words) + rnd.choice("abc") for _ in range(rnd.randrange(1, 20))) for _ in range(others)]
    rnd.shuffle(docs)
    docs += [docs[3], docs[0], "", None]
    return list(enumerate(docs))


@pytest.mark.parametrize(("ranked", "unit_rows"), [(131_072, 9), (12, None)])
def test_a_greedy_pass_lists_no_pairs_of_texts_all_near_one_another(spark, monkeypatch, ranked, unit_rows):
    monkeypatch.setattr(text_join, "RANKED", ranked)
    docs = _near_texts(random.Random(9), 40, 25)
    df = spark.createDataFrame(docs, "id long, text string")
    store = spark.createDataFrame([(docs[7][1],), ("nothing alike",), (None,)], "text string")
    edges, dropped = TS.undecided_pairs(df, store, 0.95, id_col="id", text_col="text", first=8, block_rows=unit_rows)
    pairs, gone = [(r["a"], r["b"]) for r in edges.collect()], {r["id"] for r in dropped.collect()}
    texts = {i: t for i, t in docs if t}
    near = {(a, b) for a in texts for b in texts if a < b and round(_py_cos(texts[a], texts[b]), 6) >= 0.95}
    stored = {i for i in texts if round(_py_cos(texts[i], docs[7][1]), 6) >= 0.95}
    left = [i for i in sorted(texts) if i not in stored]
    want = sequential_greedy(left, [e for e in near if not stored & set(e)])
    have = sequential_greedy([i for i in left if i not in gone], pairs)
    assert {i: have.get(i, False) for i in left} == want and stored <= gone
    assert len(near) > 700 and len(pairs) < 20


@pytest.mark.parametrize("unit_rows", [7, None])
def test_best_partners_are_one_row_for_each_task(spark, unit_rows):
    docs = _near_texts(random.Random(10), 50, 20)
    texts = {i: t for i, t in docs if t}
    keyed = TS._keyed(spark.createDataFrame(docs, "id long, text string"), "id", "text")
    (coded,), ranks = TS._coded(keyed)
    reps, _ = TS._representatives(keyed, coded)
    ids = sorted(r["id"] for r in reps.select("id").collect())
    tasks = -(-len(ids) // unit_rows) if unit_rows else 1
    cos = {(a, b): round(_py_cos(texts[a], texts[b]), 6) for a in ids for b in ids if a != b}
    found = text_join.join(reps, None, ranks, 0.95, mode=text_join.LATER, unit_rows=unit_rows).collect()
    best = {b: max([cos[a, b] for a in ids if a < b], default=0.0) for b in ids}
    have = {}
    for r in found:
        assert r["a"] < r["b"] and r["similarity"] == pytest.approx(cos[r["a"], r["b"]], abs=1e-6)
        have[r["b"]] = max(have.get(r["b"], 0.0), r["similarity"])
    assert have == pytest.approx({b: v for b, v in best.items() if v >= 0.95}, abs=1e-6)
    # 50 texts near one another have over 1,000 pairs
    assert len(found) <= len(ids) * tasks and sum(v >= 0.95 for v in cos.values()) > 2_000
    right = text_join.join(reps.filter(F.col("id") < 30), reps.filter(F.col("id") >= 30), ranks, 0.95, mode=text_join.RIGHT, unit_rows=unit_rows)
    have = {r["b"]: r["similarity"] for r in right.groupBy("b").agg(F.max("similarity").alias("similarity")).collect()}
    want = {b: max(cos[a, b] for a in ids if a < 30) for b in ids if b >= 30}
    assert have == pytest.approx({b: v for b, v in want.items() if v >= 0.95}, abs=1e-6)


def test_best_partners_are_dealt_out_in_rounds(spark, monkeypatch):
    """However many units there are, no shuffle holds more than a few copies of the rows."""
    docs = _near_texts(random.Random(11), 100, 0)
    texts = {i: t for i, t in docs if t}
    monkeypatch.setattr(text_join, "LEAST_DEALT", 1, raising=False)
    dealt, frame = [], type(spark.range(0))
    plain = frame.repartitionById

    def counted(self, *args):
        dealt.append(self.count())
        return plain(self, *args)

    monkeypatch.setattr(frame, "repartitionById", counted)
    release = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(release, "false")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["max_similarity"] for r in TS.near_duplicates(df, 0.95, block_rows=7).collect()}
    want = {b: max([round(_py_cos(texts[a], texts[b]), 6) for a in texts if a < b], default=0.0) for b in texts}
    assert got == pytest.approx({b: v for b, v in want.items() if v >= 0.95}, abs=1e-6)
    # 15 units; all at once would be 15 copies
    assert len(dealt) > 3 and max(dealt) <= (text_join.COPIES + 1) * len(docs)
    assert spark.conf.get(release, "false") == held


def test_units_are_even_and_equal_places_are_spread():
    place = np.random.default_rng(1).normal(size=(4_000, 5)).astype(np.float32)
    place[:1_500] = place[0]
    spread = np.arange(4_000) * 7_919
    tree, many = text_join._tree(place, np.ones(4_000), 250)
    counts = np.bincount(text_join._unit_of(tree, place, spread), minlength=many)
    assert len(counts) == many < 24 and counts.min() > 0 and counts.max() <= 1.25 * 250
    same = np.ones((50, 3), np.float32)
    assert text_join._tree(same, np.ones(50), 12.5) == ((0, 4), 4)
    assert set(text_join._unit_of((0, 4), same, spread[:50]).tolist()) == {0, 1, 2, 3}
    none = np.zeros((0, 3), np.float32)
    assert text_join._tree(none, np.zeros(0), 1.0) == ((0, 1), 1) and not len(text_join._unit_of((0, 1), none, spread[:0]))


def test_a_product_of_places_is_never_below_the_cosine():
    rnd = np.random.default_rng(2)
    codes = [text_join.pack(rnd.integers(0, 30 + 20 * k, 60), np.arange(25), np.arange(25, dtype=np.int32)) for k in range(40)]
    rows = text_join._Rows(np.arange(40), list(codes))
    place = rows.places(text_join._axes(rows.drawn(25))).astype(np.float64)
    assert np.linalg.norm(place, axis=1) == pytest.approx(np.ones(40), abs=1e-4)
    hashed = [np.zeros(1_000) for _ in codes]
    for dense, c in zip(hashed, codes, strict=True):
        ranks, others, counts = text_join.unpack(c)
        dense[np.concatenate([ranks, others])] = counts
    dense = np.array([d / np.linalg.norm(d) for d in hashed])
    assert (place @ place.T >= dense @ dense.T - text_join.SLACK).all()
