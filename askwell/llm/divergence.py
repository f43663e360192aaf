"""Divergence of sources from each other and from their language.

**Kept terms by iceberg prefix refinement.**  A term that stands in ``min_docs``
documents of a language has only beginnings that stand in as many.  So terms
grow level by level: the first level takes their first ``FIRST_LEVEL`` bytes,
each next one twice as many.  At each level the documents of a language are
counted for every beginning whose own beginning, one level down, was kept;
beginnings below the threshold are discarded with all that extends them.  A term
is complete at the first level that is as long as it, and kept if it reaches the
threshold there.  Refinement ends when no beginning is left to extend, after as
many levels as the logarithm of the longest kept term.

Documents lie whole in one task, so a task counts distinct documents by itself
and hands on sums: one row for each beginning or complete term of a language and
not one for each document.  A task's tables are handed on and emptied when they
hold ``FLUSH_KEYS`` keys, so memory is bounded.

**Uses.**  A second pass counts occurrences by language and source.  Tasks hand
on only terms that pass a filter of the kept ones, a bit array of fixed size; a
join takes out what passes it by chance, so a full filter costs time, not truth.

**Divergence.**  Smoothed shares of all kept terms are compared for each pair of
a language's sources in blocks of terms (numpy), which emit one partial sum for
each pair; pairs of rows of a term are never formed.

Shares and sums are whole numbers: products in decimal(38), sums of differences
in long.  A document is a row: repeated rows and rows that share an id count
each.  A null text has no terms; its language and source still are a group.
Null languages and sources are ''.  A language without kept terms has value 0
for each pair and no ``term`` rows; a language with one source has no ``pair``
rows.  Equal values are ranked by item.  An empty table gives an empty result.
Only the three columns are read, so other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askwell.llm.common import materialize, ship_package

#: bytes of the first level's beginnings
FIRST_LEVEL = 4
#: keys that a task's tables hold before they are handed on
FLUSH_KEYS = 1_000_000
#: terms of a block: at least so many, and share entries (terms x sources) at most
BLOCK_TERMS, BLOCK_ENTRIES = 2_500, 8_000_000
#: bits of the filter of kept terms that goes to all tasks (8 MB, whatever the corpus)
FILTER_BITS = 1 << 26

#: bytes by which terms are separated become spaces, A-Z become a-z
_FOLD = bytes(
    32 if b < 0x41 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if b <= 0x5A else b for b in range(256)
)
_SUMMARY = "level int, whole boolean, lang string, bytes binary, docs long"


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text, in order, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def level_of(size: int) -> int:
    """The first level whose beginnings have ``size`` bytes or more."""
    level, reach = 0, FIRST_LEVEL
    while reach < size:
        level, reach = level + 1, reach * 2
    return level


class _Tables:
    """Counters by key, and how many entries they hold together."""

    def __init__(self):
        self.held: dict[tuple, Counter] = {}
        self.keys = 0

    def add(self, key: tuple, items) -> None:
        counts = self.held.get(key)
        if counts is None:
            counts = self.held[key] = Counter()
        before = len(counts)
        counts.update(items)
        self.keys += len(counts) - before

    def empty(self) -> Iterator[tuple[tuple, Counter]]:
        held, self.held, self.keys = self.held, {}, 0
        yield from held.items()


def _summaries(slim: DataFrame) -> DataFrame:
    """Documents of complete terms and of beginnings, by language and task: rows
    of equal keys stand for different documents."""
    ship_package(slim.sparkSession)

    def rows(tables: _Tables) -> Iterator[pa.RecordBatch]:
        for (lang, size), docs in tables.empty():
            n = len(docs)
            items, counts = pa.array(docs.keys(), pa.binary()), pa.array(docs.values(), pa.int64())
            level = [level_of(len(t)) for t in docs] if size is None else [level_of(size)] * n
            yield pa.RecordBatch.from_arrays(
                [pa.array(level, pa.int32()), pa.array([size is None] * n, pa.bool_()), pa.array([lang] * n, pa.string()), items, counts],
                ["level", "whole", "lang", "bytes", "docs"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _Tables()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                longer = set(terms_of(text))
                tables.add((lang, None), longer)
                size = FIRST_LEVEL
                while longer := [t for t in longer if len(t) > size]:
                    tables.add((lang, size), {t[:size] for t in longer})
                    size *= 2
                if tables.keys > FLUSH_KEYS:
                    yield from rows(tables)
        yield from rows(tables)

    return slim.mapInArrow(run, _SUMMARY)


def _filter_of(kept: DataFrame) -> bytes:
    """One bit for each kept term, by hash: ``FILTER_BITS`` bits in all."""
    at = F.pmod(F.crc32(F.concat(F.encode("lang", "UTF-8"), F.lit(b"\0"), F.col("bytes"))), F.lit(FILTER_BITS))
    words = kept.select(at.alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("bits")
    )
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    for batch in words.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype(np.uint32)
    return out.tobytes()


def _uses(slim: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, bytes, uses) of the kept terms."""
    spark = slim.sparkSession
    passes = spark.sparkContext.broadcast(_filter_of(kept))
    mask = FILTER_BITS - 1

    def rows(tables: _Tables) -> Iterator[pa.RecordBatch]:
        bits, crc = passes.value, zlib.crc32
        for (lang, source), uses in tables.empty():
            start = crc(lang.encode() + b"\0")
            marks = [crc(t, start) & mask for t in uses]
            some = {t: n for (t, n), m in zip(uses.items(), marks, strict=True) if bits[m >> 3] >> (m & 7) & 1}
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()),
                    pa.array(some.keys(), pa.binary()), pa.array(some.values(), pa.int64()),
                ],
                ["lang", "source", "bytes", "uses"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _Tables()
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tables.add((lang, source), terms_of(text))
                if tables.keys > FLUSH_KEYS:
                    yield from rows(tables)
        yield from rows(tables)

    found = slim.mapInArrow(run, "lang string, source string, bytes binary, uses long")
    summed = found.groupBy("lang", "source", "bytes").agg(F.sum("uses").alias("uses"))
    # the filter lets some other terms pass by chance
    return summed.join(kept, ["lang", "bytes"], "left_semi")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(
        *[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
        docs["text"].cast("string").alias("text"),
    )


def kept_terms(summaries: DataFrame, min_docs: int) -> DataFrame:
    """(lang, bytes) of the terms in at least ``min_docs`` documents of a language."""
    spark = summaries.sparkSession
    kept, alive, level = [], None, 0
    while alive is None or not alive.isEmpty():
        rows = summaries.filter(F.col("level") == level)
        if alive is not None:
            # only what extends a kept beginning is counted
            stem = alive.select(F.col("lang").alias("_lang"), F.col("bytes").alias("_stem"))
            size = FIRST_LEVEL << (level - 1)
            rows = rows.join(
                stem, (F.col("lang") == F.col("_lang")) & (F.substring("bytes", 1, size) == F.col("_stem")), "left_semi"
            )
        counted = materialize(
            rows.groupBy("whole", "lang", "bytes").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs),
            f"terms-level{level}",
        )
        kept.append(counted.filter("whole").select("lang", "bytes"))
        alive = counted.filter("not whole").select("lang", "bytes")
        level += 1
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


def _share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 size)), exact."""
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (count.cast("decimal(20,0)") + 5)
    below = total.cast("decimal(20,0)") + F.lit(5).cast("decimal(1,0)") * size.cast("decimal(18,0)")
    return F.call_function("div", top, F.nullif(below, F.lit(0).cast("decimal(1,0)"))) + 1



def _pair_kernel(entries, groups):
    """Partial sums of one block of a language's terms: all pairs of sources.

    ``entries`` has the shares of the terms that sources have, ``groups`` every
    source with the share of a term that it has not."""
    import pandas as pd

    names = groups["source"].tolist()
    at = {s: k for k, s in enumerate(names)}
    term, first = np.unique(entries["bytes"].to_numpy(dtype=object), return_inverse=True) if len(entries) else ([], [])
    shares = np.tile(groups["none"].fillna(0).to_numpy(np.int64), (len(term), 1))
    if len(entries):
        shares[first, entries["source"].map(at).to_numpy(np.int64)] = entries["p"].to_numpy(np.int64)
    n = len(names)
    sums = np.zeros((n, n), np.int64)
    for k in range(n):
        sums[k] = np.abs(shares - shares[:, k : k + 1]).sum(axis=0)
    i, j = np.nonzero(~np.eye(n, dtype=bool))
    lang = groups["lang"].iloc[0] if n else ""
    return pd.DataFrame(
        {"lang": lang, "source": np.array(names, object)[i], "item": np.array(names, object)[j], "value": sums[i, j]}
    )


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """Divergence of every source of every language.

    Returns ``lang, source, part, item, value, rank``: part ``pair`` compares
    with each other source of the language, part ``term`` has the ``top`` terms
    whose share in the source lies above that in the language.
    """
    slim = _slim(docs)
    summaries = materialize(_summaries(slim), "terms-counted")
    kept = materialize(kept_terms(summaries, min_docs), "terms-kept")
    counts = materialize(_uses(slim, kept), "terms-uses")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    groups = slim.select("lang", "source").distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("uses").alias("total"))
    groups = materialize(
        groups.join(totals, ["lang", "source"], "left")
        .join(sizes, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
        .withColumn("none", _share(F.lit(0), F.col("total"), F.col("terms"))),
        "terms-groups",
    )
    per_lang = groups.groupBy("lang").agg(
        F.count(F.lit(1)).alias("sources"), F.sum("total").alias("lang_total"), F.first("terms").alias("terms")
    )
    most = F.greatest(F.lit(1), F.least(F.greatest(F.lit(BLOCK_TERMS), F.col("sources") * 4), F.floor(F.lit(BLOCK_ENTRIES) / F.col("sources"))))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") / most)).cast("int")
    per_lang = per_lang.withColumn("blocks", blocks)

    entries = (
        counts.join(groups.select("lang", "source", "total"), ["lang", "source"])
        .join(per_lang, "lang")
        .select(
            "lang", "source", "bytes", "uses", "lang_total", "terms", "blocks",
            _share(F.col("uses"), F.col("total"), F.col("terms")).alias("p"),
        )
    )
    by_block = entries.select(
        "lang", "source", "bytes", "p", F.pmod(F.xxhash64("bytes"), F.col("blocks").cast("long")).cast("int").alias("block")
    )
    all_blocks = groups.join(per_lang.select("lang", "blocks"), "lang").select(
        "lang", "source", "none", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    pairs = (
        by_block.groupBy("lang", "block")
        .cogroup(all_blocks.groupBy("lang", "block"))
        .applyInPandas(_pair_kernel, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
    )

    in_lang = (
        counts.groupBy("lang", "bytes")
        .agg(F.sum("uses").alias("lang_uses"))
        .join(per_lang, "lang")
        .select("lang", "bytes", _share(F.col("lang_uses"), F.col("lang_total"), F.col("terms")).alias("q"))
    )
    above = (
        entries.join(in_lang, ["lang", "bytes"])
        .filter(F.col("p") > F.col("q"))
        .select("lang", "source", F.col("bytes").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())

    def ranked(df: DataFrame, part: str) -> DataFrame:
        return df.select(
            "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank")
        )

    return ranked(pairs, "pair").unionByName(ranked(above, "term").filter(F.col("rank") <= top))


def op13_query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents
), words AS MATERIALIZED (
  SELECT d, lang, source, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs
), kept AS MATERIALIZED (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 30
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), grp AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(s.v, 0) AS v
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN sizes s USING (lang)
), cnt AS MATERIALIZED (
  SELECT w.lang, w.source, w.term, count(*) AS c
  FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
), dense AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, g.v,
         sum(coalesce(c.c, 0)) OVER (PARTITION BY g.lang, g.source) AS n,
         sum(coalesce(c.c, 0)) OVER (PARTITION BY g.lang) AS n_lang,
         sum(coalesce(c.c, 0)) OVER (PARTITION BY g.lang, k.term) AS c_lang
  FROM grp g JOIN kept k ON g.lang = k.lang
  LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS MATERIALIZED (
  SELECT lang, source, term, c,
         1 + (1000000000::HUGEINT * (c + 5)::HUGEINT) // (n::HUGEINT + 5 * v) AS p,
         1 + (1000000000::HUGEINT * (c_lang + 5)::HUGEINT) // (n_lang::HUGEINT + 5 * v) AS q
  FROM dense
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT s.lang, s.source, t.source AS item, sum(abs(s.p - t.p)) AS value
             FROM shares s JOIN shares t ON s.lang = t.lang AND s.term = t.term AND s.source <> t.source
             GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM parts
QUALIFY part = 'pair' OR rank <= 50
"""
