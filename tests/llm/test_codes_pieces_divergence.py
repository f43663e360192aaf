"""Vector codes, sentence pieces and source divergence against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askwell.llm import codes, divergence, pieces

SF = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
CLASHING = ("code", "v", "bytes", "whole", "level", "block", "part", "terms", "_lang", "_x", "error", "n")


# -- vector codes ----------------------------------------------------------


def coded_by_full_scans(rows, parts=4, entries=256, rounds=4, scale=1024):
    """[(vec_id, code, error, label_error)] and the final codebooks, in plain Python."""
    kept = []
    for vec_id, x, label in rows:
        if x is not None and all(c is not None and math.isfinite(c) for c in x):
            kept.append((vec_id, [math.floor(scale * c) for c in x], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[r[1][p * width : (p + 1) * width] for p in range(parts)] for r in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            at = defaultdict(list)
            for c in cut:
                at[nearest(c[p], books[p])[1]].append(c[p])
            for k, members in at.items():
                books[p][k] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    out, by_label = [], Counter()
    for (vec_id, _, label), c in zip(kept, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((vec_id, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    return [(v, k, e, by_label[label]) for v, k, e, label in out], books


def as_rows(compressed):
    df = codes.with_label_error(compressed.rows)
    got = df.select("vec_id", F.lower(F.hex("code")), "error", "label_error").collect()
    return sorted(map(tuple, got), key=str)


@pytest.mark.parametrize("groups", [1, 4, 8])
def test_codes_equal_full_scans(spark, groups):
    rnd = random.Random(groups)
    rows = [(k, [rnd.choice([0.0, 0.25, -0.5, rnd.gauss(0, 1)]) for _ in range(8)], rnd.choice([1, 2, None])) for k in range(400)]
    rows += [(k, rows[k][1], 3) for k in range(50)]  # repeated ids and vectors
    rows += [(None, [0.5] * 8, 1), (900, None, 1), (901, [None] + [0.5] * 7, 1), (902, [math.inf] + [0.5] * 7, 1)]
    rows += [(903, [math.nan] + [0.5] * 7, 1), (7, [0.1] * 8, 2), (7, [-0.1] * 8, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df = df.withColumns({c: F.lit(1) for c in CLASHING}).repartition(5)
    want, books = coded_by_full_scans(rows, entries=24)
    got = codes.compress(df, entries=24, groups=groups)
    assert got.books.tolist() == books
    assert as_rows(got) == sorted(want, key=str)
    assert sum(got.measured[1:]) < 4 * got.measured[0]  # bounds did spare distances


def test_code_bounds_hold_and_stay_tight():
    """Every kept bound is valid in each round, however old its stamp is."""
    rnd = np.random.default_rng(1)
    x = rnd.integers(-300, 300, (500, 4))
    book = codes.Codebook([x[:40].copy()], 5)
    b = book.first(x)
    for _ in range(6):
        nxt = book.history[-1].copy()
        for e in range(40):
            if (b.code == e).any():
                nxt[e] = x[b.code == e].mean(0) // 1 + rnd.integers(-40, 40, 4)
        book = codes.Codebook([*book.history, nxt], 5)
        b, _ = book.later(x, b)
        d = codes.distances(x, nxt)
        assert (b.code == d.argmin(1)).all()
        real = np.sqrt(d.astype(float))
        assert (b.upper + book.moved[b.upper_at, b.code] >= real[np.arange(500), b.code]).all()
        for g, m in enumerate(book.members):
            others = np.where(m[None, :] == b.code[:, None], np.inf, real[:, m])
            loss = np.where(book.who[b.lower_at[:, g], g] == b.code, book.rest[b.lower_at[:, g], g], book.most[b.lower_at[:, g], g])
            assert (b.lower[:, g] - loss <= others.min(1) + 1e-9).all()


def test_distances_of_large_numbers_are_exact():
    x = np.array([[2**27, -(2**27)], [2**27 - 1, 3]])
    e = np.array([[-(2**27), 2**27], [5, 7]])
    assert codes.distances(x, e).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c, strict=True)) for c in e] for r in x]


def test_codes_of_few_odd_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    empty = spark.createDataFrame([], schema)
    assert codes.compress(empty).rows.count() == 0 and codes.with_label_error(codes.compress(empty).rows).count() == 0
    nothing = spark.createDataFrame([(1, None, 1), (2, [], 1), (3, [1.0, 2.0, 3.0], 1)], schema)
    assert codes.compress(nothing).rows.count() == 0
    few = [(5, [1.0, 2.0, 3.0, 4.0], 1), (6, [1.0, 2.0, 3.0, 4.0], None), (7, [1.0] * 8, 1), (8, [1e30, 0.0, 0.0, 0.0], 1)]
    got = codes.compress(spark.createDataFrame(few, schema))
    assert as_rows(got) == sorted([(5, "00000000", 0, 0), (6, "00000000", 0, 0)], key=str)
    assert [list(r.vector) for r in codes.decompress(got).collect()] == [[1.0, 2.0, 3.0, 4.0]] * 2


def test_codes_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").limit(300)
    want, _ = coded_by_full_scans([tuple(r) for r in rows.collect()], entries=64)
    assert as_rows(codes.compress(rows, entries=64)) == sorted(want, key=str)
    got = codes.op11_query(spark, SF)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert got.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


# -- sentence pieces -------------------------------------------------------


@pytest.fixture(scope="module")
def lib():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_match_library(lib):
    bpe, rnd = pieces.PieceBPE(PIECES), random.Random(3)
    alpha = "abcdefghijklmnoABCÄöüßéñΣςİ 漢字かな\n\t.,'’!?-_#0123½\x85\x1c\xa0😀अंक▁   \x00e e t"
    cases = ["".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    names = list(bpe.id_of)
    cases += ["".join(rnd.choice(names) for _ in range(rnd.randint(1, 8))).replace("▁", rnd.choice([" ", "  ", ""])) for _ in range(4000)]
    cases += [" " * n + "a" + " " * m for n in range(40) for m in (0, 1, 17, 33)]
    cases += ["x" * 5000, "ab" * 900, "", " ", "the" * 4000, "".join(rnd.choice("etaoins") for _ in range(30_000))]
    cases += ["<s>a</s><unk>", "<0x41>", "�", "é", "\U0010ffff"]
    n, written, decoded = bpe.encode_texts(pa.array(cases))
    for text, size, ids, back in zip(cases, n.tolist(), written.to_pylist(), decoded.to_pylist(), strict=True):
        want = lib.encode(text)
        assert bpe.encode(text) == want and size == len(want) and ids == ",".join(map(str, want)), text
        assert back[1:] == lib.decode(want) == bpe.decode(want), text


def test_any_ids_decode_like_the_library(lib):
    bpe, rnd = pieces.PieceBPE(PIECES), random.Random(4)
    for _ in range(4000):
        kinds = (rnd.randrange(3, 259), rnd.randrange(32_000), rnd.randrange(259, 262), 0, 1)
        ids = [rnd.choice(kinds) for _ in range(rnd.randint(0, 6))]
        assert bpe.decode(ids) == lib.decode(ids), ids


def test_pieces_of_pairs_are_found_by_merging():
    bpe, rnd = pieces.PieceBPE(PIECES), random.Random(5)
    names = sorted(bpe.whole)
    for _ in range(3000):
        a, b = rnd.choice(names), rnd.choice(names)
        assert bpe.compatible(bpe.id_of[a], bpe.id_of[b]) == (bpe.merged(a + b) == [a, b])
    for word in ("unbelievably", "aaaaaaaaaaaaaaaaaaaa", "▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁▁x", "tttthhhheeee"):
        assert [bpe.piece[i] for i in bpe.backtrack(word)] == bpe.merged(word)


def test_piece_documents(spark, lib):
    long = "plain words and more " * 150_000  # three million characters
    rows = [(1, "plain words"), (1, "plain words"), (2, None), (3, ""), (None, "no id"), (4, " \n\t "), (5, "x" * 200_000), (6, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHING})
    got = pieces.encode_documents(df, PIECES, ids=True).collect()
    want = []
    for doc_id, text in rows:
        ids = lib.encode(text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        back = lib.decode(ids)
        want.append((doc_id, len(ids), digest, hashlib.sha256(back.encode()).hexdigest(), ids, back))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert pieces.encode_documents(df.limit(0), PIECES).count() == 0


def test_piece_query(spark, lib):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = pieces.op12_query(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


# -- source divergence -----------------------------------------------------


def audited(rows, min_docs, top):
    """The audit in plain Python; rows are (text, lang, source)."""
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    docs, uses, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in term.findall(text or "")]
        docs[lang].update(set(found))
        uses[lang, source].update(found)
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        v = len(kept)

        def share(count, total, v=v):
            return 1 + 10**9 * (count + 5) // (total + 5 * v)

        total = {s: sum(uses[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(uses[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(uses[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources - {s}]
            above = [(q[t] - p[s][t], t.encode()) for t in kept if uses[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", above, top)):
                for rank, (value, item) in enumerate(sorted(found)[:most], 1):
                    out.add((lang, s, part, item.decode(), -value, rank))
    return out


def corpus(n=300, seed=1):
    rnd = random.Random(seed)
    words = ["the", "The", "Straße", "ÄÖ", "x", "x" * 40, "x" * 41, "long" * 30, "été", "ete", "a-b", "c3po", "漢字", "漢", "thereabouts", "there"]
    rows = []
    for _ in range(n):
        text = " ".join(rnd.choice(words[: rnd.randint(1, len(words))]) for _ in range(rnd.randint(0, 30)))
        rows.append((text, rnd.choice(["en", "de", None, ""]), rnd.choice(["a", "b", "c", None, "é"])))
    return rows + [(None, "en", "null text only"), ("", "fr", "lonely"), ("once " * 50_000, "en", "a"), ("the", "xx", "few"), ("the", "xx", "words")]


@pytest.mark.parametrize(("min_docs", "blocks"), [(1, 10**6), (12, 40), (70, 10**6), (10_000, 10)])
def test_audit_equals_brute_force(spark, monkeypatch, min_docs, blocks):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 1)
    monkeypatch.setattr(divergence, "BLOCK_ENTRIES", blocks)
    rows = corpus()
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    df = df.withColumns({c: F.lit(1) for c in CLASHING}).repartition(3)
    got = divergence.audit(df, min_docs=min_docs, top=5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(audited(rows, min_docs, 5))


def test_tables_are_handed_on_when_full(monkeypatch, spark):
    rows = corpus(80, seed=2)
    df = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    monkeypatch.setattr(divergence, "FLUSH_KEYS", 3)
    monkeypatch.setattr(divergence, "FILTER_BITS", 32)  # a filter that lets most terms pass
    assert sorted(map(tuple, divergence.audit(df, 5, 5).collect())) == sorted(audited(rows, 5, 5))


def test_levels_reach_the_longest_kept_term(spark):
    rows = [("y" * 1000, "en", "s"), ("y" * 1000 + " " + "y" * 999, "en", "t"), ("yy " + "y" * 2000, "en", "t")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    kept = divergence.kept_terms(divergence._summaries(divergence._slim(df)), 2)
    assert [bytes(r.bytes) for r in kept.collect()] == [b"y" * 1000]
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    big = 9 * 10**18
    row = spark.range(1).select(divergence._share(F.lit(big - 7), F.lit(big), F.lit(10**9)).alias("p")).first()
    assert row.p == 1 + 10**9 * (big - 2) // (big + 5 * 10**9)


# -- chunked encoding for packing -------------------------------------------


def test_chunked_ids_match_library():
    from tokenizers import Tokenizer

    from askwell.llm.packing import DocumentTokens, cut

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, lib, rnd = DocumentTokens(path), Tokenizer.from_file(path), random.Random(2)
    assert enc.common is not None
    alpha = "abcdefghijABCÄöüßéñΣςİ 漢字かな\n\t.,'’!?-_#0123½\x85\x1c\xa0　 😀अंक   's 're\r\n\x00 e e t"
    safe = "abcdefg hijAB  Cé\n\t.,'!?0123 's  \n\n"
    cases = ["".join(rnd.choice(rnd.choice([alpha, safe])) for _ in range(rnd.randint(0, 60))) for _ in range(5000)]
    cases += ["<|endoftext|>x <|endoftext|> y", "", None, "x" * 30_000, "a b " * 5000, " ", "  ", "\n", " a", "a ", "\x1c\x1cab"]
    ids, ends = enc.of(pa.array(cases), 0)
    want = [[*lib.encode(c or "", add_special_tokens=False).ids, 0] for c in cases]
    assert [ids[b - len(w) : b].tolist() for b, w in zip(ends.tolist(), want, strict=True)] == want
    text, piece, start, length, _ = cut(ids, ends, 100)
    sizes = list(map(len, want))
    for k, size in enumerate(sizes):
        mine = [(int(s), int(n)) for t, s, n in zip(text, start, length, strict=True) if t == k]
        assert mine[0][0] == 0 and sum(n for _, n in mine) == size and all(n <= 100 for _, n in mine)
        assert len(mine) == max(1, -(-size // 100))


def test_memo_is_bounded_in_bytes():
    from askwell.llm.chunks import Memo

    memo = Memo(10_000)
    for k in range(1000):
        memo.keep(str(k), b"", 50)
        memo.make_room()
        assert memo.held <= 10_000 + 250
    memo.keep("x" * 500, b"", 0)
    assert "x" * 500 not in memo
