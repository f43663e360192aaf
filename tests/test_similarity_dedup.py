from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from askwell.operators import similarity as V
from askwell.operators import text_similarity as TS
from askwell.operators.components import components
from askwell.operators.dedup import greedy_dedup


def _vecs(spark, n, d, seed, offset=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d))
    rows = [(i + offset, [float(x) for x in m[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<double>"), m


def _cos(a, b):
    an = a / np.linalg.norm(a, axis=1, keepdims=True)
    bn = b / np.linalg.norm(b, axis=1, keepdims=True)
    return an @ bn.T


def test_topk_blocked_equals_brute_force(spark):
    q, qm = _vecs(spark, 37, 8, 1)
    s, sm = _vecs(spark, 53, 8, 2, offset=1000)
    sims = np.round(_cos(qm, sm), 6)
    # small blocks force the multi-block path (4 x 6 block pairs)
    got = V.topk_neighbors(q, s, 3, block_rows=10).collect()
    want = {}
    for i in range(37):
        order = sorted(range(53), key=lambda j: (-sims[i, j], j))[:3]
        want[i] = [1000 + j for j in order]
    have = {}
    for r in sorted(got, key=lambda r: (r["q_id"], r["rank"])):
        have.setdefault(r["q_id"], []).append(r["s_id"])
    assert have == want


def test_max_similarity_empty_store_and_earlier(spark):
    q, qm = _vecs(spark, 5, 4, 3)
    empty = q.limit(0)
    got = V.max_similarity(q, empty).collect()
    assert all(r["max_similarity"] == 0.0 and r["nearest_id"] is None for r in got)
    got = {r["q_id"]: r for r in V.max_similarity(q, q, only_earlier=True).collect()}
    assert got[0]["max_similarity"] == 0.0
    sims = np.round(_cos(qm, qm), 6)
    for i in range(1, 5):
        assert abs(got[i]["max_similarity"] - max(sims[i, :i])) < 1e-9


def test_dedup_gate_threshold_is_similarity(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    cand = spark.createDataFrame([(10, [1.0, 0.01]), (11, [1.0, 1.0])], "id long, embedding array<double>")
    got = {r["q_id"]: r["is_duplicate"] for r in V.dedup_gate(cand, store, 0.95).collect()}
    assert got == {10: True, 11: False}


def sequential_greedy(order, edges):
    """The sequential loop: earliest first, kept unless an earlier kept node is a neighbour."""
    nbrs = {}
    for a, b in edges:
        nbrs.setdefault(b, set()).add(a)
        nbrs.setdefault(a, set()).add(b)
    kept = {}
    for n in order:
        kept[n] = not any(kept.get(m, False) for m in nbrs.get(n, ()))
    return kept


@pytest.mark.parametrize("component_edges", [200_000, 0, 4])
def test_greedy_dedup_is_the_sequential_loop(spark, component_edges):
    rnd = random.Random(7)
    n = 60
    es = {(a, b) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.03}
    nd = spark.createDataFrame([(i,) for i in range(n)] + [(3,)], "id long")
    ed = spark.createDataFrame(sorted(es) + sorted(es)[:3] + [(5, 1000)], "src long, dst long")
    have = {r["id"]: r["kept"] for r in greedy_dedup(nd, ed, component_edges=component_edges).collect()}
    assert have == sequential_greedy(list(range(n)), es)


def test_greedy_dedup_of_no_edges_and_no_nodes(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    edges = spark.createDataFrame([], "src long, dst long")
    assert {(r["id"], r["kept"], r["round"]) for r in greedy_dedup(nodes, edges).collect()} == {(1, True, 0), (2, True, 0)}
    assert greedy_dedup(nodes.limit(0), edges).count() == 0


def test_a_long_chain_takes_few_rounds(spark):
    n = 10_000
    order = list(range(n))
    random.Random(1).shuffle(order)  # links between ids far apart
    links = [(min(a, b), max(a, b)) for a, b in zip(order, order[1:])]
    edges = spark.createDataFrame(links, "src long, dst long").repartition(16)
    rounds = []
    found = components(edges, rounds=rounds, one_task=0).collect()
    assert len(found) == n and {r["component"] for r in found} == {0}
    assert rounds[0] <= 14  # about the logarithm of its length
    nodes = spark.range(n)
    have = {r["id"]: (r["kept"], r["round"]) for r in greedy_dedup(nodes, edges).collect()}
    assert {k: v[0] for k, v in have.items()} == sequential_greedy(list(range(n)), links)
    assert {v[1] for v in have.values()} == {1}


def test_components_equal_union_find(spark):
    rnd = random.Random(2)
    es = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in es:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    for one_task in (0, 60, 10_000):
        got = components(spark.createDataFrame(es, "src long, dst long").repartition(7), one_task=one_task)
        assert {(r["node"], r["component"]) for r in got.collect()} == {(x, root(x)) for x in parent}


def _py_terms(t):
    import re

    out = {}
    for w in re.findall(r"\w+", t.lower()):
        out[w] = out.get(w, 0) + 1
    return out


def _py_cos(a, b):
    ta, tb = _py_terms(a), _py_terms(b)
    num = sum(v * tb.get(k, 0) for k, v in ta.items())
    den = (sum(v * v for v in ta.values()) ** 0.5) * (sum(v * v for v in tb.values()) ** 0.5)
    return 0.0 if den == 0 else num / den


def _texts(rnd, n, size=30, vocab=40):
    words = [f"w{i}" for i in range(vocab)]
    base = [" ".join(rnd.choice(words) for _ in range(size)) for _ in range(8)]
    docs = []
    for i in range(n):
        t = base[rnd.randrange(8)].split()
        for _ in range(rnd.randrange(4)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        docs.append((i, " ".join(t)))
    return docs


@pytest.mark.parametrize(("threshold", "head", "block_rows"), [(0.9, 255, 10), (0.95, 5, 7), (0.8, 1, 1000), (0.95, 0, 5)])
def test_near_duplicates_are_exact(spark, monkeypatch, threshold, head, block_rows):
    monkeypatch.setattr(TS, "HEAD_TERMS", head)
    docs = _texts(random.Random(3), 60)
    docs.append((60, docs[5][1]))  # exact copy
    docs += [(61, ""), (62, "?!"), (63, None)]  # no terms
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["max_similarity"] for r in TS.near_duplicates(df, threshold, block_rows=block_rows).collect()}
    want = {}
    for j in range(len(docs)):
        best = max((round(_py_cos(docs[i][1] or "", docs[j][1] or ""), 6) for i in range(j)), default=0.0)
        if best >= threshold:
            want[docs[j][0]] = best
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


@pytest.mark.parametrize(("head", "block_rows"), [(255, 1000), (3, 6)])
def test_threshold_pairs_brute_force(spark, monkeypatch, head, block_rows):
    monkeypatch.setattr(TS, "HEAD_TERMS", head)
    rnd = random.Random(4)
    vocab = [f"v{i}" for i in range(25)]
    a = [(i, " ".join(rnd.choice(vocab) for _ in range(12))) for i in range(40)] + [(50, None)]
    b = [(100 + i, " ".join(rnd.choice(vocab) for _ in range(12))) for i in range(30)] + [(5, a[7][1])]
    left, right = spark.createDataFrame(a, "id long, t string"), spark.createDataFrame(b, "id long, t string")
    got = TS.threshold_pairs(left, right, 0.5, left_id="id", left_text="t", right_id="id", right_text="t", block_rows=block_rows)
    want = {(i, j): round(_py_cos(x or "", y), 6) for i, x in a for j, y in b if round(_py_cos(x or "", y), 6) >= 0.5}
    assert {(r["a"], r["b"]): r["similarity"] for r in got.collect()} == pytest.approx(want, abs=1e-6) and want
    none = TS.threshold_pairs(left.limit(0), right, 0.5, left_id="id", left_text="t", right_id="id", right_text="t")
    assert none.count() == 0


@pytest.mark.parametrize(("head", "block_rows"), [(255, None), (4, 9), (0, 5)])
def test_text_topk_brute_force(spark, monkeypatch, head, block_rows):
    monkeypatch.setattr(TS, "HEAD_TERMS", head)
    rnd = random.Random(6)
    store = _texts(rnd, 70) + [(70, "nothing alike"), (71, "")]
    asked = _texts(rnd, 9, size=5) + [(9, "unheard words"), (10, None)]
    qs, st = spark.createDataFrame(asked, "id long, text string"), spark.createDataFrame(store, "id long, text string")
    got = TS.text_topk(qs, st, 4, q_id="id", q_text="text", s_id="id", s_text="text", block_rows=block_rows).collect()
    want = {}
    for q, x in asked:
        near = sorted((-round(_py_cos(x or "", y), 6), s) for s, y in store if _py_cos(x or "", y) > 0)
        want.update({(q, k): (s, -v) for k, (v, s) in enumerate(near[:4], 1)})
    have = {(r["q_id"], r["rank"]): (r["s_id"], r["similarity"]) for r in got}
    assert have.keys() == want.keys()
    assert all(abs(have[k][1] - want[k][1]) < 1e-6 for k in want)
    assert sum(have[k][0] != want[k][0] for k in want) == 0


def test_terms_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """With hashes of two values, the dictionary asks for another salt until none clash."""
    salts, real = [], F.xxhash64

    def coarse(*cols):
        if not isinstance(cols[0], str):
            return real(*cols)
        salts.append(cols)
        return real(*cols) % 2 if len(salts) < 3 else real(*cols)

    monkeypatch.setattr(TS.F, "xxhash64", coarse)
    monkeypatch.setattr(TS, "HEAD_TERMS", 0)
    df = spark.createDataFrame([(1, "a b c d e"), (2, "f g h i j")], "doc_id long, text string")
    (signed,) = TS._signed(TS._with_terms(df, "doc_id", "text"))
    assert len(salts) == 3 and all(len(r["tail"]) == 40 for r in signed.collect())


# --- block joins of vectors ------------------------------------------------------------


def _clusters(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    m = centres[rng.integers(0, 6, n)] + rng.normal(scale=0.15, size=(n, dim))
    m[3] = 0.0  # a zero vector
    m[n // 2 : n // 2 + n // 4] = m[5]  # one vector in a quarter of all rows
    return m


@pytest.mark.parametrize(("k", "only_earlier", "block_rows"), [(1, True, 12), (3, False, 12), (5, False, 1000), (7, True, 5)])
def test_blocked_topk_equals_brute_force(spark, k, only_earlier, block_rows):
    m = _clusters(1, 160)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(999, None)], "id long, embedding array<double>")
    got = V.topk_neighbors(df, df, k, exclude_self=True, only_earlier=only_earlier, block_rows=block_rows).collect()
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.where(norm > 0, m / np.where(norm > 0, norm, 1), 0)
    sims = np.round(unit @ unit.T, 6) + 0.0
    want = {}
    for q in range(len(m)):
        near = sorted((-sims[q, s], s) for s in range(len(m)) if s != q and (s < q or not only_earlier))
        want.update({(q, r): s for r, (_, s) in enumerate(near[:k], 1)})
    assert {(r["q_id"], r["rank"]): r["s_id"] for r in got} == want


@pytest.mark.parametrize(("threshold", "block_rows"), [(0.9, 12), (0.3, 12), (0.99, 1000), (0.97, 4)])
def test_edges_equal_brute_force_and_blocks_are_spared(spark, threshold, block_rows):
    from askwell.operators import metric_join

    m = _clusters(2, 200)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>").repartition(3)
    report = []
    signed = V._signed(df, "id", "embedding")
    got = metric_join.threshold_join(signed, None, threshold, block_rows=block_rows, report=report).collect()
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.where(norm > 0, m / np.where(norm > 0, norm, 1), 0)
    sims = np.round(unit @ unit.T, 6)
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if sims[i, j] >= threshold}
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    assert report[0].formed <= report[0].possible
    if block_rows < 100 and threshold > 0.8:
        assert report[0].formed < 0.7 * report[0].possible


def test_joins_of_empty_tables(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    assert V.similarity_edges(none, 0.5).count() == 0
    assert V.topk_neighbors(none, some, 2).count() == 0 and V.topk_neighbors(some, none, 2).count() == 0
    assert {r["max_similarity"] for r in V.max_similarity(some, none).collect()} == {0.0}


def test_lsh_pairs_subset_of_exact(spark):
    df, m = _vecs(spark, 60, 6, 5)
    exact = {(r["src"], r["dst"]) for r in V.similarity_edges(df, 0.6).collect()}
    approx = {(r["src"], r["dst"]) for r in V.lsh_pairs(df, 0.6).collect()}
    assert approx <= exact
    assert len(exact) == 0 or len(approx) / len(exact) >= 0.5


def test_embed_text_unit_vectors(spark):
    df = spark.createDataFrame([(1, "select a from b"), (2, "")], "id long, q string")
    rows = V.embed_text(df, "q", dim=64).orderBy("id").collect()
    assert abs(sum(x * x for x in rows[0]["embedding"]) - 1.0) < 1e-9
    assert all(x == 0 for x in rows[1]["embedding"])
    assert F is not None


def test_bucket_join_pairs_units_not_rows(spark):
    """pairs that share a bucket in some table and reach the threshold, by
    units; units without a common bucket are never paired."""
    import numpy as np

    from askwell.operators import metric_join
    from askwell.session import materialize

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    vec = centres[rng.integers(0, 6, 600)] + 0.3 * rng.normal(size=(600, 8))
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    side = rng.integers(0, 3, 600)
    buckets = np.stack([side, 10 + side, 100 + side * 7 + rng.integers(0, 2, 600)], axis=1)
    df = spark.createDataFrame(
        [(i, v.tolist(), b.tolist()) for i, (v, b) in enumerate(zip(vec, buckets, strict=True))], "id long, v array<double>, buckets array<long>"
    )
    report = []
    got = metric_join.bucket_join(materialize(df, "bucket-test"), 0.9, unit_rows=50, report=report)
    cos = vec @ vec.T
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if round(cos[i, j], 6) >= 0.9 and (buckets[i] == buckets[j]).any()}
    rows = got.collect()
    assert {(r["a"], r["b"]) for r in rows} == want and len(rows) == len(want)
    assert report[0].formed < report[0].possible


def test_lsh_pairs_of_one_full_bucket(spark):
    """all rows in one bucket, a repeated row and a null vector; no join by bucket."""
    from askwell.operators.similarity import lsh_pairs

    data = [(i, [1.0, 0.001 * i]) for i in range(300)] + [(7, [1.0, 0.007]), (400, None)]
    out = lsh_pairs(spark.createDataFrame(data, "id long, embedding array<double>"), 0.4, bucket_length=4.0, num_tables=2)
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()
    pairs = [(r["src"], r["dst"]) for r in out.collect()]
    assert len(pairs) == len(set(pairs)) == 300 * 299 // 2


def test_topk_keeps_only_words_of_the_queries(spark, monkeypatch):
    """of a store text only the words that a query has are counted and stored;
    its norm is still that of all its words."""
    from askwell.operators import text_similarity as TS

    monkeypatch.setattr(TS, "HEAD_TERMS", 1)
    q = spark.createDataFrame([(1, "red green blue")], "id long, text string")
    s = spark.createDataFrame([(1, "red green " + " ".join(f"w{i}" for i in range(14))), (2, "green blue"), (3, "x y")], "id long, text string")
    asked, held = TS._with_terms(q, "id", "text"), TS._with_terms(s, "id", "text")
    _, signed = TS._signed(asked, held, within=asked)
    assert max(len(r["tail"]) // 8 for r in signed.collect()) <= 2
    for most in (200_000, 2):  # more words than may be sent: all are kept
        monkeypatch.setattr(TS, "MOST_WITHIN", most)
        got = {r["s_id"]: r["similarity"] for r in TS.text_topk(q, s, 3, q_id="id", q_text="text", s_id="id", s_text="text").collect()}
        assert got == {2: round(2 / 6**0.5, 6), 1: round(2 / 48**0.5, 6)}
