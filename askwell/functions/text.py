"""Column functions over SQL / question texts.

All are built-in Catalyst expressions (regexp_*, trim, lower, size), so they
run inside whole-stage codegen on the executors; no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour):
#   write keywords (whole word, case-insensitive):
#     DROP, DELETE, TRUNCATE, ALTER, INSERT, UPDATE, CREATE, GRANT, REVOKE
#   fenced SQL: the body of the first ``` fence, optional "sql" tag
#   per-example token overhead: 10
#   validation reasons: "SQL is empty",
#     "Write operations are not allowed in read-only mode."
# ---------------------------------------------------------------------------
WRITE_KEYWORDS = ("DROP", "DELETE", "TRUNCATE", "ALTER", "INSERT", "UPDATE", "CREATE", "GRANT", "REVOKE")
WRITE_PATTERN = r"(?i)\b(" + "|".join(WRITE_KEYWORDS) + r")\b"
FENCE_PATTERN = r"(?s)```(?:sql)?\s*(.*?)\s*```"
EXAMPLE_TOKEN_OVERHEAD = 10
REASON_EMPTY = "SQL is empty"
REASON_WRITE = "Write operations are not allowed in read-only mode."

# word pieces: runs of letters/digits/underscore, or single other non-space
# characters; \p{L}/\p{N} keep accented words whole in both Java and RE2
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
TERM_PATTERN = r"[\p{L}\p{N}_]+"
# a name right after a whole-word FROM/JOIN; the boundary is spelled out
# (Java's and RE2's \b disagree next to accented letters)
REF_PATTERN = r"(?:^|[^\p{L}\p{N}_])(?:from|join)\s+([\p{L}\p{N}_]+)"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Python ``str.strip()``: leading/trailing whitespace of any kind
    (``F.trim`` only removes spaces)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def clean_sql(raw: Column | str) -> Column:
    """Body of the first fenced block if there is one, else the trimmed text."""
    raw = _c(raw)
    fenced = raw.rlike(FENCE_PATTERN)
    return F.when(fenced, F.regexp_extract(raw, FENCE_PATTERN, 1)).otherwise(strip_ws(raw))


def normalize_sql(sql: Column | str) -> Column:
    """Trim, drop trailing ';', lower-case, collapse whitespace, no space
    just inside parentheses."""
    s = strip_ws(F.coalesce(_c(sql), F.lit("")))
    s = F.lower(F.regexp_replace(s, r";+$", ""))
    s = F.regexp_replace(s, r"\s+", " ")
    s = F.regexp_replace(s, r"\(\s+", "(")
    return F.regexp_replace(s, r"\s+\)", ")")


def count_tokens(text: Column | str) -> Column:
    """Word-piece token estimate (the BPE vocabulary is not available
    offline; callers may pass their own counter wherever one is accepted)."""
    return F.size(F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(TOKEN_PATTERN), 0))


def example_block(question: Column | str, sql: Column | str, explanation: Column | str | None = None) -> Column:
    """``Question: ..\\nSQL: ..[\\nExplanation: ..]`` (explanation only if non-empty)."""
    base = F.concat(F.lit("Question: "), F.coalesce(_c(question), F.lit("")),
                    F.lit("\nSQL: "), F.coalesce(_c(sql), F.lit("")))
    if explanation is None:
        return base
    e = F.coalesce(_c(explanation), F.lit(""))
    return F.when(e == "", base).otherwise(F.concat(base, F.lit("\nExplanation: "), e))


def example_cost(question, sql, explanation=None, counter=count_tokens) -> Column:
    """Tokens of the example block plus a fixed overhead."""
    return counter(example_block(question, sql, explanation)) + F.lit(EXAMPLE_TOKEN_OVERHEAD)


def has_write_keyword(sql: Column | str) -> Column:
    """whole-word write keyword anywhere (a flag, not a security boundary)."""
    return F.coalesce(_c(sql), F.lit("")).rlike(WRITE_PATTERN)


def is_blank(sql: Column | str) -> Column:
    """NULL, empty or whitespace-only."""
    return ~F.coalesce(_c(sql), F.lit("")).rlike(r"\S")


def terms(text: Column | str) -> Column:
    """Lower-cased word terms of a text (array<string>)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(TERM_PATTERN), 0)


def tables_referenced(df: DataFrame, text_col: str, key_col: str, table_names: DataFrame) -> DataFrame:
    """for each row, the sorted set of known table names that follow a FROM or
    JOIN keyword.

    One projection: the names pulled out by a regex are kept if they are in the
    catalogue's listing, which is a literal of the plan (one name per table).
    """
    known = [r[0] for r in table_names.select(F.lower("table_name")).distinct().collect()]
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(REF_PATTERN), 1)
    names = F.array(*[F.lit(n) for n in sorted(known)]).cast("array<string>")
    return df.select(key_col, F.array_sort(F.array_intersect(found, names)).alias("tables_used"))
