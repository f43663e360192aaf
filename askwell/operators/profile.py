"""Table profiles for prompts (P1), keys checked on the data (P3) and table
row counts (A14).

Spark's catalog holds no declared keys, so P3 tests them on the data: a
column is a candidate key iff it has no NULL and count = count distinct; a
foreign key holds iff the child has no value missing from the parent
(``left_anti`` count 0).  All counts run as distributed aggregations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegralType,
    StructField,
    StructType,
)

# Fixed value: sample rows per table in a profile (reference default 3)
SAMPLE_ROWS = 3


def ddl_text(
    table_name: str,
    fields: list[tuple[str, ...]],
    primary_key: list[str] | None = None,
    foreign_keys: list[tuple[str, str, str]] | None = None,
) -> str:
    """``CREATE TABLE`` text, one clause per line: the columns (name, type and
    any constraints), then the keys that are known."""
    columns = (" ".join([name, typ.upper(), *constraints]) for name, typ, *constraints in fields)
    own_key = [f"PRIMARY KEY ({', '.join(primary_key)})"] if primary_key else []
    others = (f"FOREIGN KEY ({c}) REFERENCES {t}({r})" for c, t, r in foreign_keys or ())
    clauses = ",\n  ".join([*columns, *own_key, *others])
    return f"CREATE TABLE {table_name} (\n  {clauses}\n);"


def schema_fields(schema: StructType) -> list[tuple[str, ...]]:
    """Name and type of each column, then NOT NULL and the DEFAULT that the schema
    states (Spark keeps a column's default in its metadata)."""
    return [
        (f.name, f.dataType.simpleString())
        + (() if f.nullable else ("NOT NULL",))
        + tuple(f"DEFAULT {v}" for k, v in f.metadata.items() if k == "CURRENT_DEFAULT")
        for f in schema.fields
    ]


def _sample(df: DataFrame, n: int) -> DataFrame:
    """``n`` rows as JSON texts, numbers with four digits after the point: those with
    the smallest digest of their whole numbers (of all columns where there are none),
    then the smallest text.  The same rows come out however the table is split; each
    task keeps ``n`` rows.  The first pass reads the whole numbers only; rows beyond
    its ``n`` smallest digests are never written as text."""

    def shown(f: StructField) -> Column:
        c, real = F.col(f.name), (DoubleType, FloatType, DecimalType)
        if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, real):
            cells = F.transform(c, lambda v: F.coalesce(F.round(v, 4).try_cast("decimal(38,4)").cast("string"), v.cast("string")))
            return F.concat(F.lit("["), F.array_join(cells, ", ", "null"), F.lit("]"))
        if isinstance(f.dataType, real):
            return F.coalesce(F.round(c, 4).try_cast("decimal(38,4)").cast("string"), c.cast("string"))
        return c.cast("string")

    fields = df.schema.fields
    whole = [f for f in fields if isinstance(f.dataType, IntegralType)] or fields
    key = F.concat_ws("|", *[F.coalesce(shown(f), F.lit("")) for f in whole])
    row = F.to_json(F.struct(*[shown(f).alias(f.name) for f in fields]), {"ignoreNullFields": "false"})
    h = F.md5(key)
    last = df.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h")).scalar()
    return df.filter(h <= last).select(h.alias("h"), row.alias("r")).orderBy("h", "r").limit(n)


def table_profiles(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    *,
    sample_rows: int = SAMPLE_ROWS,
    keys: dict[str, list[str]] | None = None,
    foreign_keys: dict[str, list[tuple[str, str, str]]] | None = None,
) -> DataFrame:
    """One row per table (table_name, ddl, columns, column_descriptions,
    sample_rows as JSON texts, row_count).  Comments are those of the columns'
    metadata.  The loop over table names only builds the plan; counts and samples
    are computed by Spark.  An empty table has no sample rows and a count of 0."""
    parts = []
    for name, df in tables.items():
        ddl = ddl_text(name, schema_fields(df.schema), (keys or {}).get(name), (foreign_keys or {}).get(name))
        comment = {f.name: str(f.metadata.get("comment", "")) for f in df.schema.fields}
        cols = F.array(*[
            F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"),
                     F.lit(f.nullable).alias("nullable"), F.lit(comment[f.name]).alias("comment"))
            for f in df.schema.fields
        ])
        descr = F.create_map(*[F.lit(x) for pair in comment.items() for x in pair])
        sample = _sample(df, sample_rows).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("h", "r"))), lambda x: x["r"]).alias("sample_rows")
        )
        parts.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), F.lit(ddl).alias("ddl"), cols.alias("columns"),
            descr.alias("column_descriptions"), sample.scalar().alias("sample_rows"), "row_count",
        ))
    return reduce(DataFrame.unionByName, parts)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """COUNT(*) per table as one union of global aggregates."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def key_profile(tables: dict[str, DataFrame], candidates: dict[str, list[str]]) -> DataFrame:
    """P3 keys: (table_name, column_name, row_count, null_count,
    distinct_count, is_key) for each candidate column."""
    parts = []
    for name, cols in candidates.items():
        counted = tables[name].agg(
            F.count(F.lit(1)).alias("row_count"),
            *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{k}") for k, c in enumerate(cols)],
            *[F.countDistinct(c).alias(f"distinct_{k}") for k, c in enumerate(cols)],
        )
        each = F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(f"null_{k}").alias("null_count"), F.col(f"distinct_{k}").alias("distinct_count"))
            for k, c in enumerate(cols)
        ])
        parts.append(counted.select("row_count", F.explode(each).alias("c")).select(
            F.lit(name).alias("table_name"), "c.column_name", "row_count", "c.null_count", "c.distinct_count",
            ((F.col("c.null_count") == 0) & (F.col("c.distinct_count") == F.col("row_count"))).alias("is_key"),
        ))
    return reduce(DataFrame.unionByName, parts)


def foreign_key_profile(
    tables: dict[str, DataFrame], fks: list[tuple[str, str, str, str]]
) -> DataFrame:
    """P3 foreign keys: (child, column, parent, parent_column, orphans, holds)
    with orphans = child rows whose non-NULL value is missing in the parent."""
    parts = []
    for child, col, parent, pcol in fks:
        c = tables[child].select(F.col(col).alias("_k")).filter(F.col("_k").isNotNull())
        p = tables[parent].select(F.col(pcol).alias("_k"))
        orphans = c.join(p, "_k", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
        parts.append(orphans.select(
            F.lit(child).alias("child"), F.lit(col).alias("column_name"), F.lit(parent).alias("parent"),
            F.lit(pcol).alias("parent_column"), "orphans", (F.col("orphans") == 0).alias("holds"),
        ))
    return reduce(DataFrame.unionByName, parts)


# Fixed value: tables of the vector store that are never business tables
INTERNAL_TABLES = ("langchain_pg_collection", "langchain_pg_embedding")


def table_allow_list(spark: SparkSession, allowed: list[str] | None = None,
                     internal: tuple[str, ...] = INTERNAL_TABLES) -> DataFrame:
    """catalogue tables minus internal ones, restricted to ``allowed``
    when given (an empty list keeps nothing; None keeps all)."""
    names = [t.name for t in spark.catalog.listTables()]
    keep = [n for n in names if n not in internal and (allowed is None or n in allowed)]
    return spark.createDataFrame([(n,) for n in sorted(keep)], "table_name string")
