"""V0t: engine-independent text cosine on term counts.

A text becomes term ids with w = tf / ||tf||; the cosine of two texts is the sum
over shared terms of w_a * w_b.  Threshold joins run in ``text_join``.  Top-k joins
run in ``metric_join``: a text's signature has its weights of the ``HEAD_TERMS`` most frequent terms and the norm of the
others, so a product of two signatures bounds the cosine from above, blocks of
signatures are ruled out by angles, and only pairs that reach the bound have the
rest of their terms compared.  Frequent terms are dimensions there and not keys,
so no posting list is ever joined with itself.  Exact copies are collapsed first.

Terms travel as 64-bit hashes.  The dictionary that counts documents shows
whether two terms share a hash; if so, all hashes are taken anew with another
salt, until none do.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askwell.functions.text import TERM_PATTERN, terms
from askwell.operators import metric_join, text_join
from askwell.operators.dedup import greedy_dedup
from askwell.session import materialize, shuffles_released

#: terms that are dimensions of a signature
HEAD_TERMS = 255
#: words of one side that are sent to every task, at most
MOST_WITHIN = 200_000
#: texts that a greedy pass settles first
FIRST_TEXTS = 2_048


def _with_terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # a text without terms has a zero vector: cosine 0 with everything
    slim = _spread(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")))
    words = slim.select("id", terms("text").alias("words"))
    return words.filter(F.size("words") > 0)


def _spread(df: DataFrame) -> DataFrame:
    """A scan of less partitions than there are cores (one small file) is dealt
    out before its texts are taken apart; larger scans stay as they are."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _signed(*texts: DataFrame, within: DataFrame | None = None) -> list[DataFrame]:
    """Stored signatures of tables of (id, words), over one dictionary.

    ``within``: one of the tables, if every pair has a side there.  Words that it
    hasn't add nothing to a cosine beyond a text's norm, so they are neither counted
    nor kept, unless it has more than ``MOST_WITHIN`` words."""
    salt = 0
    words = texts[0].select("words")
    for t in texts[1:]:
        words = words.unionAll(t.select("words"))
    words = words.select(F.explode(F.array_distinct("words")).alias("word"))
    while True:
        hashed = words.withColumn("term", F.xxhash64("word", F.lit(salt)))
        allowed = None
        if within is not None:
            mine = within.select(F.explode("words").alias("word")).select(F.xxhash64("word", F.lit(salt)).alias("_term")).distinct()
            mine = materialize(mine.limit(MOST_WITHIN + 1), "query-terms")
            if mine.count() <= MOST_WITHIN:
                allowed = np.sort(mine.toArrow().column(0).to_numpy().astype(np.int64))
                hashed = hashed.join(F.broadcast(mine), F.col("term") == F.col("_term"), "left_semi")
        # a second hash tells words of one id apart; numbers keep the aggregation in place
        other = F.xxhash64(F.lit(-1 - salt), "word")
        dictionary = hashed.groupBy("term").agg(F.count(F.lit(1)).alias("df"), (F.min(other) != F.max(other)).alias("clash"))
        dictionary = materialize(dictionary, "dictionary")
        if dictionary.filter("clash").isEmpty():
            break
        salt += 1
    top = dictionary.orderBy(F.col("df").desc(), "term").limit(HEAD_TERMS).select("term").collect()
    head = np.sort(np.array([r["term"] for r in top], np.int64))
    hashed = [t.select("id", F.transform("words", lambda w: F.xxhash64(w, F.lit(salt))).alias("terms")) for t in texts]
    return [materialize(metric_join.text_signatures(h, head, allowed), "text-signatures") for h in hashed]


def text_topk(
    queries: DataFrame,
    store: DataFrame,
    k: int,
    *,
    q_id: str,
    q_text: str,
    s_id: str,
    s_text: str,
    block_rows: int | None = None,
) -> DataFrame:
    """k most similar store texts per query text by term cosine.

    Returns (q_id, rank, s_id, similarity).  Pairs sharing no term have
    similarity 0 and are never ranked (the reference's store returns nearest
    neighbours by vector; a zero-overlap text is not a neighbour here)."""
    asked = _with_terms(queries, q_id, q_text)
    q, s = _signed(asked, _with_terms(store, s_id, s_text), within=asked)
    return metric_join.ranked(metric_join.topk_join(q, s, k, positive_only=True, block_rows=block_rows), k)


def _coded(*texts: DataFrame) -> tuple[list[DataFrame], int]:
    """Tables (.., words) with packed term counts ``code`` in place of the words,
    over one dictionary, and the number of its terms that travel as ranks."""
    words = texts[0].select("words")
    for t in texts[1:]:
        words = words.unionAll(t.select("words"))
    words = words.select(F.explode(F.array_distinct("words")).alias("word"))
    salt = 0
    while True:
        other = F.xxhash64(F.lit(-1 - salt), "word")
        dictionary = words.withColumn("term", F.xxhash64("word", F.lit(salt))).groupBy("term").agg(
            F.count(F.lit(1)).alias("df"), (F.min(other) != F.max(other)).alias("clash")
        )
        dictionary = materialize(dictionary, "dictionary")
        if dictionary.filter("clash").isEmpty():
            break
        salt += 1
    # whole classes of equal frequency, as many as fit
    classes = sorted(dictionary.groupBy("df").count().collect(), reverse=True)
    fit = np.cumsum([r["count"] for r in classes]) <= text_join.RANKED
    least = classes[int(fit.sum()) - 1]["df"] if fit.any() else None
    top = dictionary.filter(F.col("df") >= least if least is not None else F.lit(False)).select("term", "df").toArrow()
    term, df = (top.column(c).to_numpy().astype(np.int64) for c in ("term", "df"))
    ranked = term[np.lexsort((term, -df))]

    def hashed(t: DataFrame) -> DataFrame:
        return t.withColumn("words", F.transform("words", lambda w: F.xxhash64(w, F.lit(salt))))

    return [text_join.packed(hashed(t), ranked) for t in texts], len(ranked)


def _direct() -> int:
    """Ranks that have a component of their own in a signature."""
    return 2 * (HEAD_TERMS + 1)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, words) of texts with terms; ``h`` is equal for equal texts."""
    slim = _spread(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")))
    slim = slim.filter(F.col("id").isNotNull() & F.lower("text").rlike(TERM_PATTERN))
    return slim.select("id", F.sha2(F.col("text"), 256).alias("h"), terms("text").alias("words"))


def _representatives(keyed: DataFrame, coded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored (id, code, h) of the earliest copy of each text, and (id, rep) of later ones."""
    reps = coded.groupBy("h").agg(F.min("id").alias("_rep"), F.min_by("code", "id").alias("code"))
    reps = materialize(reps.select(F.col("_rep").alias("id"), "code", "h"), "text-reps")
    copies = keyed.select("id", "h").join(reps.select("h", F.col("id").alias("rep")), "h").filter(F.col("id") != F.col("rep"))
    return reps, copies.select("id", "rep")


def threshold_pairs(
    left: DataFrame,
    right: DataFrame,
    threshold: float,
    *,
    left_id: str,
    left_text: str,
    right_id: str,
    right_text: str,
    block_rows: int | None = None,
) -> DataFrame:
    """(a, b, similarity) for left text a and right text b with term cosine
    >= threshold."""
    sides = [_with_terms(left, left_id, left_text), _with_terms(right, right_id, right_text)]
    (a, b), ranks = _coded(*sides)
    a, b = materialize(a, "left-texts"), materialize(b, "right-texts")
    return text_join.join(a, b, ranks, threshold, direct=_direct(), unit_rows=block_rows)


def self_pairs(
    docs: DataFrame, threshold: float, *, id_col: str, text_col: str, block_rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Within one set ordered by id: returns (edges, copies).

    ``copies`` (id, rep): texts identical to an earlier text; ``rep`` is the
    earliest copy.  ``edges`` (a, b, similarity), a < b, among representatives
    only — copies never need pairing (a later copy always has similarity 1 to
    its representative)."""
    keyed = _keyed(docs, id_col, text_col)
    (coded,), ranks = _coded(keyed)
    reps, copies = _representatives(keyed, coded)
    return text_join.join(reps, None, ranks, threshold, direct=_direct(), unit_rows=block_rows), copies


def undecided_pairs(
    docs: DataFrame,
    store: DataFrame,
    threshold: float,
    *,
    id_col: str,
    text_col: str,
    first: int = FIRST_TEXTS,
    block_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """What a greedy pass in the order of the ids needs: returns (edges, dropped).

    A text is dropped if it is near a text of ``store`` (text_col), copies an earlier
    text or is near an earlier accepted one.  ``dropped`` (id) holds the texts for which
    this is settled here, ``edges`` (a, b, similarity) all pairs of the others that reach
    ``threshold``.  Texts near one another in great numbers have as many pairs as the
    square of that; so the earliest texts are settled first, what is near an accepted
    one of these goes, and only what is left is paired, in growing parts."""
    keyed = _keyed(docs, id_col, text_col)
    held = _with_terms(store.select(F.monotonically_increasing_id().alias("sid"), F.col(text_col).alias("text")), "sid", "text")
    (coded, kept), ranks = _coded(keyed, held)
    reps, copies = _representatives(keyed, coded)
    kept = materialize(kept, "store-texts")

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        found = text_join.join(left, right, ranks, threshold, mode=text_join.RIGHT, direct=_direct(), unit_rows=block_rows)
        return materialize(found.select(F.col("b").alias("id")).distinct(), "near-texts")

    def but(rows: DataFrame, gone: DataFrame) -> DataFrame:
        return rows.join(gone.select(F.col("id").alias("_gone")), F.col("id") == F.col("_gone"), "left_anti")

    gone = near(kept, reps)
    dropped = [copies.select("id"), gone]
    rest = materialize(but(reps.select("id", "code"), gone), "rest-texts")
    n = rest.count()
    while n > 4 * first:
        border = rest.agg(F.percentile_approx("id", first / n, 10_000)).first()[0]
        early, later = rest.filter(F.col("id") <= border), rest.filter(F.col("id") > border)
        edges = text_join.join(early, None, ranks, threshold, direct=_direct(), unit_rows=block_rows)
        greedy = greedy_dedup(early.select("id"), edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        greedy = materialize(greedy.select("id", "kept"), "first-texts")
        lost = greedy.filter(~F.col("kept")).select("id")
        accepted = materialize(but(early, lost), "accepted-texts")
        gone = near(accepted, later)
        dropped += [lost, gone]
        rest = materialize(but(later, gone), "rest-texts")
        n, first = rest.count(), 16 * first
    edges = text_join.join(rest, None, ranks, threshold, direct=_direct(), unit_rows=block_rows)
    out = dropped[0]
    for d in dropped[1:]:
        out = out.unionByName(d)
    return edges, out


def near_duplicates(
    docs: DataFrame, threshold: float = 0.95, *, id_col: str = "doc_id", text_col: str = "text", block_rows: int | None = None
) -> DataFrame:
    """Texts whose best term cosine to an *earlier* text (smaller id) is
    >= threshold.  Returns (id_col, max_similarity); one row per duplicate.
    For a representative the best earlier text is another representative (an
    earlier copy's own representative is earlier still, with equal cosine)."""
    keyed = _keyed(docs, id_col, text_col)
    with shuffles_released(docs.sparkSession):
        (coded,), ranks = _coded(keyed)
        reps, copies = _representatives(keyed, coded)
    found = text_join.join(reps, None, ranks, threshold, mode=text_join.LATER, direct=_direct(), unit_rows=block_rows)
    best = found.groupBy(F.col("b").alias("id")).agg(F.max("similarity").alias("max_similarity"))
    dup_copies = copies.select("id", F.lit(1.0).alias("max_similarity"))
    return best.unionByName(dup_copies).select(F.col("id").alias(id_col), "max_similarity")
