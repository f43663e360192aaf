"""Example memory for many questions at once: token budget (V7, V8),
selection strategies (G1-G4) and prompt assembly (V9, V10).

Everything is per question and bounded by k (or 2k candidates), so every
window / collect_list below works on at most 2k rows per question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askwell.functions.text import count_tokens, example_cost

# ---------------------------------------------------------------------------
# Fixed values (defaults of the reference):
#   few-shot k = 3, over-fetch 2k = 6, prompt budget 3500 tokens,
#   base prompt reserve 500 tokens, random selection seed 42
# ---------------------------------------------------------------------------
FEW_SHOT_K = 3
OVERFETCH = 2
MAX_PROMPT_TOKENS = 3500
BASE_PROMPT_TOKENS = 500
RANDOM_SEED = 42

# ---------------------------------------------------------------------------
# Prompt text (must equal the reference's layout)
# ---------------------------------------------------------------------------
SYSTEM_PROMPT = """\
You are an expert SQL analyst.  Your job is to translate natural-language
questions into precise, executable PostgreSQL queries.

RULES
─────
1. Return ONLY the SQL query — no markdown fences, no explanation.
2. Always use explicit column names (no SELECT *).
3. Prefer CTEs over nested sub-queries for readability.
4. Use table aliases when joining.
5. LIMIT results to 100 rows unless the user specifies otherwise.
6. Never generate INSERT, UPDATE, DELETE, DROP, or any DDL statement.
"""

CONVENTION_RULES = (
    ("revenue", "always computed from order_items (quantity × unit_price), NOT\n  from orders.total_amount."),
    ("completed", "orders → status IN ('shipped', 'delivered')."),
    ("net order value", "total_amount − discount (shipping is excluded)."),
    ("valid", "orders → exclude BOTH cancelled AND returned."),
    ("active customer", "has at least one valid order."),
    ("basket size", "number of items (quantity), not dollar amount."),
    ("fulfillment rate", "delivered / (total − cancelled)."),
)

BEHAVIORAL_HEAD = """\
── REFERENCE EXAMPLES (BUSINESS CONVENTIONS) ──────────────
Below are expert-approved question→SQL pairs that define how this organisation
interprets business terms.  **Follow these conventions exactly**:

• "revenue" → always computed from order_items (quantity × unit_price), NOT
  from orders.total_amount.
• "completed" orders → status IN ('shipped', 'delivered').
• "net order value" → total_amount − discount (shipping is excluded).
• "valid" orders → exclude BOTH cancelled AND returned.
• "active customer" → has at least one valid order.
• "basket size" → number of items (quantity), not dollar amount.
• "fulfillment rate" → delivered / (total − cancelled).

Use the examples below to understand patterns and conventions, but adapt the
SQL to the specific question asked.

"""
KNOWLEDGE_HEAD = "── DATABASE SCHEMA ─────────────────────────────────────────\n"
EXECUTIVE_HEAD = "── USER QUESTION ───────────────────────────────────────────\n"
EXECUTIVE_TAIL = "\n\nGenerate the PostgreSQL query now.\n"


# --- V8 / V7 -----------------------------------------------------------------


def schema_tokens(profiles: DataFrame, counter=count_tokens) -> Column:
    """V8 as a scalar subquery: sum of DDL tokens over the table profiles."""
    return profiles.agg(F.coalesce(F.sum(counter(F.col("ddl"))), F.lit(0))).scalar()


def budget_select(
    candidates: DataFrame,
    questions: DataFrame,
    *,
    schema_tokens_col: Column | int = 0,
    k: int = FEW_SHOT_K,
    max_tokens: int = MAX_PROMPT_TOKENS,
    base_tokens: int = BASE_PROMPT_TOKENS,
    counter=count_tokens,
) -> DataFrame:
    """V7: per question, take candidates in rank order while they fit.

    ``candidates``: (q_id, rank, s_id, cost) — the 2k nearest with the token
    cost of each example.  ``questions``: (q_id, question).
    remaining = budget - base - schema tokens - question tokens; <= 0 gives
    nothing.  Since every cost is >= 10, "stop at the first example that does
    not fit" equals "running cost <= remaining", a per-question running sum.
    Returns the selected rows with (q_id, rank, s_id, cost, running_cost, remaining).
    """
    st = schema_tokens_col if isinstance(schema_tokens_col, Column) else F.lit(schema_tokens_col)
    q = questions.select(
        "q_id",
        (F.lit(max_tokens) - F.lit(base_tokens) - st - counter(F.col("question"))).alias("remaining"),
    )
    w = Window.partitionBy("q_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    c = candidates.join(q, "q_id").withColumn("running_cost", F.sum("cost").over(w))
    return c.filter(
        (F.col("remaining") > 0) & (F.col("running_cost") <= F.col("remaining")) & (F.col("rank") <= k)
    )


# --- selection strategies -------------------------------------------------------

EXAMPLE_TYPE = "array<struct<question:string,sql_query:string>>"


def select_zero(questions: DataFrame) -> DataFrame:
    """G1: no examples."""
    return questions.select("q_id", F.array().cast(EXAMPLE_TYPE).alias("examples"))


def select_static(questions: DataFrame, pool: DataFrame, k: int = FEW_SHOT_K, id_col: str = "example_id") -> DataFrame:
    """The first k pool examples (by id) for every question.  The k rows
    are a bounded literal, so no join is needed."""
    first = pool.orderBy(id_col).select("question", "sql_query").limit(k).collect()
    examples = F.array(*[
        F.struct(F.lit(r["question"]).alias("question"), F.lit(r["sql_query"]).alias("sql_query")) for r in first
    ]).cast(EXAMPLE_TYPE)
    return questions.select("q_id", examples.alias("examples"))


def select_random(
    questions: DataFrame,
    pool: DataFrame,
    k: int = FEW_SHOT_K,
    seed: int = RANDOM_SEED,
    id_col: str = "example_id",
) -> DataFrame:
    """K examples without replacement per question, from a pool of any size.

    Floyd's draw picks k different positions out of n, every set equally likely:
    draw i takes a position up to n - k + i, or n - k + i itself if that one is
    taken.  Its numbers are md5(seed|question_id|i), the same in any
    partitioning and in SQL.  The positions then join the pool in id order, so k
    rows per question move and the pool stays distributed.  A pool of fewer
    than k examples is taken whole; ids are expected to be distinct."""
    from askwell.operators.ranking import global_rank

    placed = global_rank(pool.select(id_col, "question", "sql_query"), [F.col(id_col).asc()], "_place")
    n = placed.count()
    take = min(k, n)
    if take == 0:
        return select_zero(questions)

    def draw(taken: Column, i: Column) -> Column:
        text = F.concat_ws("|", F.lit(str(seed)), F.col("q_id").cast("string"), i.cast("string"))
        last = i + F.lit(n - take)
        at = F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"), last + 1)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, at), last).otherwise(at)))

    turns = F.sequence(F.lit(0).cast("bigint"), F.lit(take - 1).cast("bigint"))
    drawn = questions.select("q_id").distinct().select(
        "q_id", F.posexplode(F.aggregate(turns, F.array().cast("array<bigint>"), draw)).alias("_turn", "_at")
    )
    picked = drawn.join(placed, F.col("_at") + 1 == F.col("_place")).groupBy("q_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_turn", "question", "sql_query"))),
            lambda e: F.struct(e["question"].alias("question"), e["sql_query"].alias("sql_query")),
        ).alias("examples")
    )
    return questions.select("q_id").join(picked, "q_id", "left")


def attach_examples(selected: DataFrame, store: DataFrame, s_id: str = "example_id") -> DataFrame:
    """(q_id, rank, s_id) + store texts -> (q_id, examples array in rank order)."""
    j = selected.join(
        store.select(F.col(s_id).alias("s_id"), "question", "sql_query"), "s_id"
    )
    return j.groupBy("q_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "question", "sql_query"))),
            lambda e: F.struct(e["question"].alias("question"), e["sql_query"].alias("sql_query")),
        ).alias("examples")
    )


# --- V9 prompt ------------------------------------------------------------------


def convention_rules(spark) -> DataFrame:
    """The business-term definitions as a table (term, rule)."""
    return spark.createDataFrame(list(CONVENTION_RULES), "term string, rule string")


def schema_section(profiles_rows: list[tuple[str, int | None, str]]) -> str:
    """Knowledge section from (table_name, row_count, ddl) rows; '' if none.
    A row count of 0 prints 0 (the reference printed '?', D11)."""
    if not profiles_rows:
        return ""
    blocks = [
        f"-- Table: {name}  ({'?' if n is None else n} rows)\n{ddl}\n" for name, n, ddl in profiles_rows
    ]
    return KNOWLEDGE_HEAD + "\n".join(blocks) + "\n"


def schema_section_col(blocks: list[tuple[str, Column, str]]) -> Column:
    """Knowledge section as a Column when row counts are computed by Spark:
    ``blocks`` = (table_name, row_count column, ddl)."""
    parts = []
    for i, (name, n, ddl) in enumerate(blocks):
        if i:
            parts.append(F.lit("\n"))
        parts += [F.lit(f"-- Table: {name}  ("), F.coalesce(n.cast("string"), F.lit("?")),
                  F.lit(f" rows)\n{ddl}\n")]
    return F.concat(F.lit(KNOWLEDGE_HEAD), *parts, F.lit("\n"))


def build_prompts(
    questions: DataFrame,
    examples: DataFrame | None,
    schema_text: str | Column = "",
    counter=count_tokens,
) -> DataFrame:
    """V9: (q_id, question) + (q_id, examples) -> (q_id, system, user, tokens, n_examples).

    Sections: examples block only when there are examples, schema block only
    when there is schema text, question block always; joined with a newline.
    """
    q = questions.select("q_id", "question")
    if examples is not None:
        q = q.join(examples, "q_id", "left")
    else:
        q = q.withColumn("examples", F.lit(None).cast(EXAMPLE_TYPE))
    ex = F.coalesce(F.col("examples"), F.array().cast(EXAMPLE_TYPE))
    blocks = F.transform(
        ex, lambda e: F.concat(F.lit("Question: "), e["question"], F.lit("\nSQL:\n"), e["sql_query"], F.lit("\n"))
    )
    behavioral = F.when(F.size(ex) > 0, F.concat(F.lit(BEHAVIORAL_HEAD), F.array_join(blocks, "\n"), F.lit("\n")))
    if isinstance(schema_text, Column):
        knowledge = schema_text
    else:
        knowledge = F.lit(schema_text) if schema_text else F.lit(None).cast("string")
    executive = F.concat(F.lit(EXECUTIVE_HEAD), F.col("question"), F.lit(EXECUTIVE_TAIL))
    user = F.concat_ws("\n", behavioral, knowledge, executive)
    return q.select(
        "q_id",
        F.lit(SYSTEM_PROMPT).alias("system"),
        user.alias("user"),
        (counter(F.lit(SYSTEM_PROMPT)) + counter(user)).alias("tokens"),
        F.size(ex).alias("n_examples"),
    )


def candidate_costs(neighbors: DataFrame, store: DataFrame, s_id: str = "example_id", counter=count_tokens) -> DataFrame:
    """(q_id, rank, s_id) + store -> adds the example's token cost.
    Costs are computed where the stored texts are read (map side), so only
    (id, cost) pairs take part in the join — never the texts themselves."""
    costs = store.select(
        F.col(s_id).alias("s_id"),
        example_cost(F.col("question"), F.col("sql_query"), F.col("explanation"), counter).alias("cost"),
    )
    return neighbors.join(costs, "s_id")


#: more than any seed has entries: their positions lie this far before the first question
SEED_BEFORE = 1 << 40


def select_dynamic_feedback(
    questions: DataFrame,
    seed: DataFrame,
    k: int = FEW_SHOT_K,
    threshold: float = 0.95,
    block_rows: int | None = None,
) -> DataFrame:
    """Dynamic selection over a store that grows while the benchmark runs.

    ``questions``: (q_id, seq, question, gold_sql, correct, embedding) —
    ``seq`` is the answering order and ``correct`` the outcome of the
    dynamic strategy; ``seed``: (example_id, question, sql_query, embedding), ids
    unique.  Ties in similarity go to the seed by id, then to the earlier answer.
    A correctly answered question joins the store (greedy dedup in answering
    order against the seed and the earlier additions); question j sees the
    seed plus additions with seq < j.  Returns (q_id, examples)."""
    from askwell.operators.dedup import greedy_dedup
    from askwell.operators.ranking import global_rank
    from askwell.operators.similarity import dedup_gate, similarity_edges, topk_neighbors

    # seed entries get negative positions in the order of their ids: earlier than any question
    seed_pos = global_rank(seed, [F.col("example_id")], "pos").select(
        (F.col("pos") - F.lit(SEED_BEFORE)).alias("pos"), "question", "sql_query", "embedding"
    )
    correct = questions.filter(F.col("correct")).select("seq", "question", F.col("gold_sql").alias("sql_query"), "embedding")
    dup_seed = dedup_gate(correct, seed_pos, threshold, q_id="seq", s_id="pos", block_rows=block_rows) \
        .filter(F.col("is_duplicate")).select(F.col("q_id").alias("seq"))
    rest = correct.join(dup_seed, "seq", "left_anti")
    edges = similarity_edges(rest, threshold, id_col="seq", block_rows=block_rows)
    kept = greedy_dedup(rest.select("seq"), edges, id_col="seq").filter(F.col("kept")).select("seq")
    learned = rest.join(kept, "seq", "left_semi")
    store = seed_pos.unionByName(learned.select(F.col("seq").cast("long").alias("pos"), "question", "sql_query", "embedding"))
    q = questions.select(F.col("seq").cast("long").alias("pos"), "q_id", "embedding")
    near = topk_neighbors(q, store, k, q_id="pos", s_id="pos", only_earlier=True, block_rows=block_rows)
    ex = near.join(store.select(F.col("pos").alias("s_id"), "question", "sql_query"), "s_id").groupBy("q_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "question", "sql_query"))),
            lambda e: F.struct(e["question"].alias("question"), e["sql_query"].alias("sql_query")),
        ).alias("examples")
    )
    ids = q.select(F.col("pos").alias("q_id"), F.col("q_id").alias("qid"))
    return ids.join(ex, "q_id", "left").select(
        F.col("qid").alias("q_id"), F.coalesce("examples", F.array().cast(EXAMPLE_TYPE)).alias("examples")
    )
