"""Quality rules and a hashed n-gram log-likelihood ratio, in Spark SQL functions only.

Base rules count words, symbols, repeated lines and repeated word triples.  The
method's verdict compares two multinomials over hashed n-grams of word shapes
(a word's first two and last two characters): one of trusted documents
(labelled quality 1), one of the whole raw corpus.  A document's score is its
mean log ratio per n-gram.  It passes at or above a threshold; every document is
held against that one number.  One half of the trusted documents makes their
multinomial, and the threshold is the score that all but ``loss`` of the other
half reach, as documents score higher against counts that they are part of.

Documents stay in their partitions: n-grams are looked up in an array of
``buckets`` weights.  To tell trusted documents, ids and bucket numbers (not
texts) are joined with the labels' ids; bucket counts are shuffled after partial
sums.  All but the verdict is stored, and the threshold is taken from there.

Nothing is sampled: the trusted counts and the threshold cover every trusted
document, the raw counts and all rules every document.  The threshold is a
quantile sketch's, off by a rank of one in ``RANKS`` at most.  Triples, lines and
n-grams are compared by 64-bit hashes within a document.

Defined cases: null or empty text has no words, fails and has score 0; without
any trusted document both multinomials are even and the threshold is null, so
that only the base rules decide; null ids and repeated rows stay, one row each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.llm.common import materialize, text_or_empty

SPACE = " \t\n\x0b\f\r"
RANKS = 100_000  # the threshold's rank is off by one in so many at most


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def _shape(word: Column) -> Column:
    return F.concat(F.substring(word, 1, 2), F.substring(word, -2, 2))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often it is used:
    a column that is used inside a higher-order function may be put in its place
    by the optimizer, and would then be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _steps(n: Column, kind: str = "int") -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast(f"array<{kind}>"))


def _grams(words: Column, n: int, buckets: int) -> Column:
    """Bucket of each n-gram of word shapes, with one end mark on either side."""
    mark = F.array(F.lit("\n"))
    return let(
        F.concat(mark, F.transform(words, _shape), mark),
        lambda full: F.transform(
            _steps(F.size(full) - (n - 1)),
            lambda i: F.pmod(F.xxhash64(*[F.get(full, i + k) for k in range(n)]), F.lit(buckets)).cast("int"),
        ),
    )


def _slim(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all trusted documents."""
    return labels.filter("quality = 1 and doc_id is not null").select(labels["doc_id"].cast("long").alias("_id")).distinct()


def weights(docs: DataFrame, trusted: DataFrame, n: int = 2, buckets: int = 8192) -> DataFrame:
    """One row, one column: the log ratio of each bucket, add-one smoothed."""
    # two bytes a bucket where that holds them
    grams = let(_words(F.col("text")), lambda w: _grams(w, n, buckets).cast("array<smallint>" if buckets <= 1 << 15 else "array<int>"))
    # null ids match nothing; their rows are dealt by text, so that they aren't one task
    rows = docs.select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("_at"), grams.alias("g"))
    ids = trusted.withColumn("_t", F.lit(1)).hint("shuffle_hash")  # rows of buckets needn't be sorted
    marked = rows.join(ids, (F.col("_at") == F.col("_id")) & F.col("doc_id").isNotNull(), "left")
    counted = (
        marked.select(F.explode(F.col("g").cast("array<int>")).alias("g"), F.coalesce("_t", F.lit(0)).alias("t"))
        .groupBy("g").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("good"))
    )
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    filled = every.join(counted, F.col("b") == F.col("g"), "left").select(
        "b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good")
    )
    # at most ``buckets`` rows meet here
    rows = F.array_sort(F.collect_list(F.struct("b", "raw", "good")))
    sums = filled.agg(rows.alias("r"), F.sum("raw").alias("all_raw"), F.sum("good").alias("all_good"))
    return sums.select(
        F.transform(
            "r",
            lambda x: F.log((x["good"] + 1.0) / (F.col("all_good") + float(buckets)))
            - F.log((x["raw"] + 1.0) / (F.col("all_raw") + float(buckets))),
        ).alias("w")
    )


def _score(words: Column, table: Column, n: int, buckets: int) -> Column:
    """Mean log ratio per n-gram, by the array of weights ``table``."""
    total = let(
        _grams(words, n, buckets),
        lambda g: F.aggregate(g, F.lit(0.0), lambda a, x: a + F.get(table, x)) / F.size(g),
    )
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.round(total, 9))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    return let(F.transform(lines, lambda x: F.xxhash64(x)), lambda h: F.size(h) - F.size(F.array_distinct(h)))


def _repeat_words(words: Column) -> Column:
    """Words in triples that are found twice or more."""

    def places(s: Column) -> Column:
        def twice(x: Column, k: Column) -> Column:
            same = [F.coalesce(F.get(s, k + d)["h"] == x["h"], F.lit(False)) for d in (-1, 1)]
            return F.when(same[0] | same[1], x["i"])

        return F.sort_array(F.filter(F.transform(s, twice), lambda p: p.isNotNull()))

    def covered(p: Column) -> Column:
        # each triple covers three words, less those that the next one covers
        own = F.transform(p, lambda a, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - a, F.lit(3))))
        return F.aggregate(own, F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        by_triple = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        found = let(by_triple, lambda s: let(places(s), covered))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(found)

    triples = F.transform(_steps(F.size(words) - 2), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(3)]))
    return let(triples, count)


def judge(
    docs: DataFrame,
    labels: DataFrame,
    n: int = 2,
    buckets: int = 8192,
    loss: float = 0.005,
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, llr`` for every row of ``docs``."""
    slim = _slim(docs, text_col)
    trusted = trusted_ids(labels)
    half = F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(2))
    # ``buckets`` numbers, whatever the corpus; a literal of the plan from here on
    table = F.lit(np.array(weights(slim, trusted.filter(half == 0), n, buckets).first()["w"], np.float64))
    text = F.col("text")
    by_words = let(
        _words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            _score(w, table, n, buckets).alias("llr"),
        ),
    )
    got = slim.select(
        "doc_id", by_words.alias("by"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        _dup_lines(text).cast("long").alias("n_dup_lines"),
    )
    failed = (F.col("by.n_words") < 50) | (100 * F.col("by.n_repeat_words") > 50 * F.col("by.n_words"))
    found = materialize(
        got.select(
            "doc_id", "by.n_words", "by.word_chars", "n_symbols", "n_dup_lines", "by.n_repeat_words",
            failed.alias("base_failed"), F.col("by.llr").alias("llr"),
        ),
        "quality-scores",
    )
    among = found.filter("n_words >= 50").join(trusted.filter(half == 1), F.col("doc_id") == F.col("_id"), "left_semi")
    threshold = among.agg(F.percentile_approx("llr", loss, RANKS).alias("t"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold.scalar(), F.lit(True))
    return found.select(*found.columns[:-1], kept.alias("kept"), "llr")


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
