"""What a SQL text reads, as column expressions (E9): literals and comments are
blanked, names after FROM and JOIN taken, common table expressions left out, and
the rest held against a catalogue by an anti-join.

The scan finds necessary conditions only: one query, closed quotes and brackets,
known tables.  Names after a bracketed subquery in a comma list, and quoted names
with other characters than letters, digits and underscores, are not looked at;
columns and types are not checked.  All of it is regular expressions inside Spark,
so texts stay where they are read; the patterns work in DuckDB as they stand.

Null and empty texts read nothing.  Repeated rows and ids are scanned row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askwell.functions.text import REASON_EMPTY, REASON_WRITE, has_write_keyword, is_blank
from askwell.session import materialize

_EDGE = r"(^|[^\p{L}\p{N}_.])"
_NAME = r"[\p{L}_][\p{L}\p{N}_]*"
_QUALIFIED = rf"{_NAME}(?:\s*\.\s*{_NAME}){{0,3}}"
_MARK = "\x01"

# a plainly quoted name is kept without its quotes; the others become a space
BLANKED = "\"([\\p{L}\\p{N}_]+)\"|`([\\p{L}\\p{N}_]+)`|\"[^\"]*\"|`[^`]*`|'[^']*'|--[^\\n]*|/\\*(?s:.*?)\\*/"
# FROM inside a function call or a comparison
OTHER_FROM = rf"(?i){_EDGE}(?:distinct\s+from|(?:extract|trim|substring|overlay)\s*\([^()]*?\sfrom)\s"
READS = rf"(?i){_EDGE}(?:from|join)\s+"
SEGMENT = rf"{_MARK}([^{_MARK}();]*\(?)"
RELATION = rf"^\s*({_QUALIFIED})"
CALL = rf"^\s*{_QUALIFIED}\s*\("
WHOLE_ITEM = rf"(?i)^\s*{_QUALIFIED}(?:\s+(?:as\s+)?{_NAME})?\s*$"
LAST_PART = rf"({_NAME})$"
NAMED_QUERY = rf"(?i)({_NAME})(?:\s*\([^()]*\)\s*|\s+)as\s*(?:(?:not\s+)?materialized\s*)?\("
ONE_QUERY = r"(?i)^[\s(]*(?:select|with)(?:[^\p{L}\p{N}_]|$)"
LEFT_OPEN = "['\"`;]|/\\*"
AT_END = " \t\n\f\r;"  # cut off by characters: a pattern would go over every run of spaces again

REASON_SHAPE = "EXPLAIN failed: not one complete query"
REASON_TABLE = "EXPLAIN failed: unknown table "


def blanked(sql: Column | str) -> Column:
    """The text without literals, comments and the quotes of plain names."""
    c = F.col(sql) if isinstance(sql, str) else sql
    return F.regexp_replace(F.coalesce(c, F.lit("")), BLANKED, "$1$2 ")


def one_query(blank: Column) -> Column:
    """Whether a blanked text can be one complete query."""
    body = F.rtrim(blank, F.lit(AT_END))
    opened, closed = (F.length(body) - F.length(F.replace(body, F.lit(b), F.lit(""))) for b in "()")
    return body.rlike(ONE_QUERY) & ~body.rlike(LEFT_OPEN) & (opened == closed)


def tables_read(blank: Column) -> Column:
    """Sorted lower-case names of the tables that a blanked text reads."""
    marked = F.regexp_replace(F.regexp_replace(blank, OTHER_FROM, "$1 "), READS, f"$1{_MARK}")

    def relations(segment: Column) -> Column:
        items = F.split(segment, ",")
        ends = F.array_position(F.transform(items, lambda i: i.rlike(WHOLE_ITEM)), False)
        listed = F.slice(items, 1, F.when(ends == 0, F.size(items)).otherwise(ends).cast("int"))
        return F.transform(
            F.filter(listed, lambda i: ~i.rlike(CALL)),
            lambda i: F.lower(F.regexp_extract(F.regexp_extract(i, RELATION, 1), LAST_PART, 1)),
        )

    found = F.flatten(F.transform(F.regexp_extract_all(marked, F.lit(SEGMENT), 1), relations))
    own = F.transform(F.regexp_extract_all(blank, F.lit(NAMED_QUERY), 1), F.lower)
    return F.array_sort(F.array_except(found, F.array_append(own, F.lit(""))))


def validate_texts(texts: DataFrame, sql_col: str, catalogue: DataFrame) -> DataFrame:
    """``texts`` with ``reason``: NULL where the text passes, else why it fails
    (empty, write keyword, no complete query, the first unknown table by name).

    ``catalogue`` (table_name) may be of any size.  It is joined with the different
    sets of names that the texts read, never with the texts.
    """
    early = F.when(is_blank(F.col(sql_col)), F.lit(REASON_EMPTY)).when(has_write_keyword(F.col(sql_col)), F.lit(REASON_WRITE))
    # columns of their own: each is used several times and computed once
    blank = texts.withColumn("_early", early).withColumn("_blank", F.when(F.col("_early").isNull(), blanked(sql_col)))
    cheap = F.coalesce("_early", F.when(~one_query(F.col("_blank")), F.lit(REASON_SHAPE)))
    scanned = blank.withColumn("_cheap", cheap).withColumn("_names", F.when(F.col("_cheap").isNull(), tables_read(F.col("_blank"))))
    scanned = scanned.drop("_early", "_blank")
    # stored before it is filtered: a filter on the names moves to the texts and repeats the whole scan there
    sets = materialize(scanned.select("_names").distinct(), "name-sets").filter(F.size("_names") > 0)
    known = catalogue.select(F.lower("table_name").alias("_table")).distinct()
    unknown = (
        sets.select("_names", F.explode("_names").alias("_table")).join(known, "_table", "left_anti")
        .groupBy("_names").agg(F.min("_table").alias("_unknown"))
    )
    reason = F.coalesce("_cheap", F.concat(F.lit(REASON_TABLE), F.col("_unknown")))
    return scanned.join(unknown, "_names", "left").withColumn("reason", reason).drop("_cheap", "_names", "_unknown")


def validation_sql(sql: str, known: str, blank: str = "blank") -> dict[str, str]:
    """The same for DuckDB: expressions ``blank`` (over ``sql``), ``cheap`` (over both)
    and ``unknown`` (over ``blank``; ``known`` is a list expression of the catalogue)."""

    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    body = f"rtrim({blank}, {text(AT_END)})"
    marked = (
        f"regexp_replace(regexp_replace({blank}, {text(OTHER_FROM)}, '\\1 ', 'g'), {text(READS)}, '\\1{_MARK}', 'g')"
    )
    items = "string_split(segment, ',')"
    ends = f"list_position(list_transform({items}, lambda i: regexp_matches(i, {text(WHOLE_ITEM)})), false)"
    relation = f"regexp_extract(regexp_extract(i, {text(RELATION)}, 1), {text(LAST_PART)}, 1)"
    listed = f"list_slice({items}, 1, coalesce(nullif({ends}, 0), len({items})))"
    names = f"list_transform(list_filter({listed}, lambda i: NOT regexp_matches(i, {text(CALL)})), lambda i: lower({relation}))"
    found = f"flatten(list_transform(regexp_extract_all({marked}, {text(SEGMENT)}, 1), lambda segment: {names}))"
    own = f"list_transform(regexp_extract_all({blank}, {text(NAMED_QUERY)}, 1), lambda n: lower(n))"
    from askwell.functions.text import WRITE_PATTERN

    return {
        "blank": f"regexp_replace(coalesce({sql}, ''), {text(BLANKED)}, '\\1\\2 ', 'g')",
        "cheap": f"""CASE WHEN NOT regexp_matches(coalesce({sql}, ''), '\\S') THEN {text(REASON_EMPTY)}
  WHEN regexp_matches({sql}, {text(WRITE_PATTERN)}) THEN {text(REASON_WRITE)}
  WHEN NOT (regexp_matches({body}, {text(ONE_QUERY)}) AND NOT regexp_matches({body}, {text(LEFT_OPEN)})
    AND length({body}) - length(replace({body}, '(', '')) = length({body}) - length(replace({body}, ')', '')))
  THEN {text(REASON_SHAPE)} END""",
        "unknown": f"list_min(list_filter({found}, lambda n: n <> '' AND NOT list_contains({known}, n) AND NOT list_contains({own}, n)))",
    }
