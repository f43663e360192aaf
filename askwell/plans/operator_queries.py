"""Queries for the library operators over the driver tables, with the DuckDB
oracle text wherever SQL can express the same result.

Table roles (all derived from the driver tables, so work grows with them):
  * documents / conversations  -> SQL-ish texts for the text functions
  * embeddings                 -> the vector memory (arrival order = vec_id)
  * benchmark x documents      -> questions x example store for retrieval,
                                  token budget and prompt assembly
  * events                     -> traces ('view') and scores ('purchase')
  * documents + labels         -> feedback candidates with human scores
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askwell.functions import text as X
from askwell.functions.vectors import sql_cosine
from askwell.operators import similarity as V
from askwell.operators import text_similarity as TS
from askwell.operators.memory import FEW_SHOT_K, RANDOM_SEED
from askwell.plans.catalog import register
from askwell.sources.tables import Tables

_TOK = X.TOKEN_PATTERN
_TERM = X.TERM_PATTERN
_WS = r"^\s+|\s+$"


def _t(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --- text functions ----------------------------------------------------------------


def x_count_tokens(spark, sf_dir) -> DataFrame:
    d = _t(spark, sf_dir).documents
    return d.select("doc_id", X.count_tokens("text").alias("n_tokens"))


register(
    "x_count_tokens",
    x_count_tokens,
    f"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), {_sql_str(_TOK)})) AS INTEGER) AS n_tokens "
    "FROM documents",
)


def _conversation_pairs(t: Tables) -> DataFrame:
    """A user turn and the assistant turn right after it, as (question, answer)."""
    c = t.conversations
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return u.join(a, ["conv_id", "turn"])


_PAIRS_SQL = """(SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
   FROM conversations u JOIN conversations a
     ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def x_example_cost(spark, sf_dir) -> DataFrame:
    p = _conversation_pairs(_t(spark, sf_dir))
    return p.select("conv_id", "turn", X.example_cost(F.col("question"), F.col("answer")).alias("cost"))


register(
    "x_example_cost",
    x_example_cost,
    f"""SELECT conv_id, turn,
  CAST(len(regexp_extract_all('Question: ' || coalesce(question, '') || chr(10) || 'SQL: ' || coalesce(answer, ''),
       {_sql_str(_TOK)})) + 10 AS INTEGER) AS cost
FROM {_PAIRS_SQL} p""",
)


def x_clean_sql(spark, sf_dir) -> DataFrame:
    c = _t(spark, sf_dir).conversations.filter(F.col("role") == "assistant")
    return c.select("conv_id", "turn", X.clean_sql("text").alias("sql"))


register(
    "x_clean_sql",
    x_clean_sql,
    f"""SELECT conv_id, turn,
  CASE WHEN regexp_matches(text, {_sql_str(X.FENCE_PATTERN)})
       THEN regexp_extract(text, {_sql_str(X.FENCE_PATTERN)}, 1)
       ELSE regexp_replace(text, {_sql_str(_WS)}, '', 'g') END AS sql
FROM conversations WHERE role = 'assistant'""",
)


def x_normalize_sql(spark, sf_dir) -> DataFrame:
    c = _t(spark, sf_dir).conversations
    return c.select("conv_id", "turn", X.normalize_sql("text").alias("normalized"))


register(
    "x_normalize_sql",
    x_normalize_sql,
    f"""SELECT conv_id, turn,
  regexp_replace(regexp_replace(regexp_replace(
    lower(regexp_replace(regexp_replace(coalesce(text, ''), {_sql_str(_WS)}, '', 'g'), ';+$', '')),
    '\\s+', ' ', 'g'), '\\(\\s+', '(', 'g'), '\\s+\\)', ')', 'g') AS normalized
FROM conversations""",
)


def x_write_guard(spark, sf_dir) -> DataFrame:
    d = _t(spark, sf_dir).documents
    return d.select("doc_id", X.has_write_keyword("text").alias("has_write"), X.is_blank("text").alias("is_blank"))


register(
    "x_write_guard",
    x_write_guard,
    f"""SELECT doc_id, regexp_matches(coalesce(text, ''), {_sql_str(X.WRITE_PATTERN)}) AS has_write,
  length(regexp_replace(coalesce(text, ''), {_sql_str(_WS)}, '', 'g')) = 0 AS is_blank
FROM documents""",
)


def _known_tables(spark: SparkSession) -> DataFrame:
    from askwell.sources.tables import TABLES

    names = list(TABLES) + ["customers", "products", "order_items", "reviews"]
    return spark.createDataFrame([(n,) for n in names], "table_name string")


def x_tables_referenced(spark, sf_dir) -> DataFrame:
    d = _t(spark, sf_dir).documents
    return X.tables_referenced(d, "text", "doc_id", _known_tables(spark))


def _known_tables_sql() -> str:
    from askwell.sources.tables import TABLES

    names = list(TABLES) + ["customers", "products", "order_items", "reviews"]
    return "(VALUES " + ", ".join(f"('{n}')" for n in names) + ") AS k(table_name)"


register(
    "x_tables_referenced",
    x_tables_referenced,
    f"""WITH c AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), {_sql_str(X.REF_PATTERN)}, 1)) AS name
  FROM documents),
hits AS (SELECT c.doc_id, list_sort(list(DISTINCT c.name)) AS tables_used
  FROM c JOIN {_known_tables_sql()} ON k.table_name = c.name GROUP BY c.doc_id)
SELECT d.doc_id, coalesce(h.tables_used, CAST([] AS VARCHAR[])) AS tables_used
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN hits h ON h.doc_id = d.doc_id""",
)


# --- vector memory on embeddings -------------------------------------------------

_EMB_PAIRS = f"""(SELECT q.vec_id AS q_id, s.vec_id AS s_id,
    ROUND({sql_cosine('q.embedding', 's.embedding')}, 6) AS similarity
  FROM embeddings q, embeddings s WHERE q.vec_id <> s.vec_id)"""


def v_topk_embeddings(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir).embeddings
    return V.topk_neighbors(e, e, 3, q_id="vec_id", s_id="vec_id", exclude_self=True)


register(
    "v_topk_embeddings",
    v_topk_embeddings,
    f"""SELECT q_id, rank, s_id, similarity FROM (
  SELECT q_id, s_id, similarity,
         CAST(row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, s_id) AS BIGINT) AS rank
  FROM {_EMB_PAIRS} p) r WHERE rank <= 3""",
)


def v_max_similarity(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir).embeddings
    return V.max_similarity(e, e, q_id="vec_id", s_id="vec_id", only_earlier=True)


_EARLIER_BEST = f"""(SELECT q_id, s_id, similarity FROM (
    SELECT q_id, s_id, similarity,
           row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, s_id) AS rn
    FROM {_EMB_PAIRS} p WHERE s_id < q_id) r WHERE rn = 1)"""

register(
    "v_max_similarity",
    v_max_similarity,
    f"""SELECT e.vec_id AS q_id, b.s_id AS nearest_id, coalesce(b.similarity, 0.0) AS max_similarity
FROM embeddings e LEFT JOIN {_EARLIER_BEST} b ON b.q_id = e.vec_id""",
)

DEDUP_T_EMB = 0.40


def v_dedup_gate(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir).embeddings
    return V.dedup_gate(e, e, DEDUP_T_EMB, q_id="vec_id", s_id="vec_id", only_earlier=True)


register(
    "v_dedup_gate",
    v_dedup_gate,
    f"""SELECT e.vec_id AS q_id, b.s_id AS nearest_id, coalesce(b.similarity, 0.0) AS max_similarity,
       coalesce(b.similarity, 0.0) >= {DEDUP_T_EMB} AS is_duplicate
FROM embeddings e LEFT JOIN {_EARLIER_BEST} b ON b.q_id = e.vec_id""",
)


def v_similarity_edges(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir).embeddings
    return V.similarity_edges(e, DEDUP_T_EMB, id_col="vec_id")


register(
    "v_similarity_edges",
    v_similarity_edges,
    f"SELECT s_id AS src, q_id AS dst, similarity FROM {_EMB_PAIRS} p "
    f"WHERE s_id < q_id AND similarity >= {DEDUP_T_EMB}",
)


def v_lsh_pairs(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir).embeddings
    return V.lsh_pairs(e, DEDUP_T_EMB, id_col="vec_id")


register("v_lsh_pairs", v_lsh_pairs)  # approximate: rows-only check


def v_lsh_recall(spark, sf_dir) -> DataFrame:
    """V3 against the exact edges: their number, whether V3 gave no other pair,
    and whether it found nine in ten of them."""
    e = _t(spark, sf_dir).embeddings
    found = V.lsh_pairs(e, DEDUP_T_EMB, id_col="vec_id").select("src", "dst").withColumn("f", F.lit(1))
    exact = V.similarity_edges(e, DEDUP_T_EMB, id_col="vec_id").select("src", "dst").withColumn("x", F.lit(1))
    both = exact.join(found, ["src", "dst"], "full")
    return both.agg(
        F.count("x").alias("exact_pairs"),
        (F.count("f") == F.count(F.when(F.col("x").isNotNull(), F.col("f")))).alias("only_exact_pairs"),
        (F.count(F.when(F.col("x").isNotNull(), F.col("f"))) >= F.count("x") * 0.9).alias("recall_reached"),
    )


register(
    "v_lsh_recall",
    v_lsh_recall,
    f"""SELECT COUNT(*) AS exact_pairs, TRUE AS only_exact_pairs, TRUE AS recall_reached
FROM {_EMB_PAIRS} p WHERE s_id < q_id AND similarity >= {DEDUP_T_EMB}""",
)


# --- text similarity on documents / benchmark ---------------------------------------

DEDUP_T_TEXT = 0.95

_TERM_W_SQL = """(SELECT id, term, tf / sqrt(SUM(tf * tf) OVER (PARTITION BY id)) AS w FROM (
   SELECT id, term, COUNT(*) AS tf FROM (
     SELECT {id} AS id, unnest(regexp_extract_all(lower(coalesce({text}, '')), {pat})) AS term FROM {table}
   ) x GROUP BY id, term) y)"""


def _term_w_sql(table: str, id_col: str, text_col: str = "text") -> str:
    return _TERM_W_SQL.format(id=id_col, text=text_col, pat=_sql_str(_TERM), table=table)


def t_near_duplicates(spark, sf_dir) -> DataFrame:
    d = _t(spark, sf_dir).documents
    return TS.near_duplicates(d, DEDUP_T_TEXT)


register(
    "t_near_duplicates",
    t_near_duplicates,
    f"""WITH w AS {_term_w_sql('documents', 'doc_id')},
pairs AS (SELECT a.id AS a, b.id AS b, ROUND(SUM(a.w * b.w), 6) AS sim
  FROM w a JOIN w b ON a.term = b.term AND a.id < b.id GROUP BY a.id, b.id)
SELECT b AS doc_id, MAX(sim) AS max_similarity FROM pairs WHERE sim >= {DEDUP_T_TEXT} GROUP BY b""",
)


def t_topk_documents(spark, sf_dir) -> DataFrame:
    t = _t(spark, sf_dir)
    return TS.text_topk(t.benchmark, t.documents, 6, q_id="item_id", q_text="text", s_id="doc_id", s_text="text")


_TOPK_DOCS_SQL = f"""(SELECT q_id, rank, s_id, similarity FROM (
  SELECT q_id, s_id, similarity,
         CAST(row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, s_id) AS BIGINT) AS rank
  FROM (SELECT q.id AS q_id, s.id AS s_id, ROUND(SUM(q.w * s.w), 6) AS similarity
        FROM {_term_w_sql('benchmark', 'item_id')} q JOIN {_term_w_sql('documents', 'doc_id')} s
          ON q.term = s.term GROUP BY q.id, s.id) p) r WHERE rank <= 6)"""

register("t_topk_documents", t_topk_documents, f"SELECT * FROM {_TOPK_DOCS_SQL} t")


# --- greedy dedup (V6) on embeddings ------------------------------------------------


def v_greedy_dedup(spark, sf_dir) -> DataFrame:
    from askwell.operators.dedup import greedy_dedup

    e = _t(spark, sf_dir).embeddings
    edges = V.similarity_edges(e, DEDUP_T_EMB, id_col="vec_id")
    return greedy_dedup(e.select("vec_id"), edges, id_col="vec_id").select("vec_id", "kept")


# the sequential rule, one vector a step in arrival order, with the kept ids so far
_GREEDY_SQL = f"""WITH RECURSIVE near AS MATERIALIZED (
  SELECT q_id AS id, list(s_id) AS earlier FROM {_EMB_PAIRS} p
  WHERE s_id < q_id AND similarity >= {DEDUP_T_EMB} GROUP BY q_id),
steps AS MATERIALIZED (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i, coalesce(earlier, []) AS earlier
  FROM embeddings LEFT JOIN near ON near.id = vec_id),
walk(i, ids) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT s.i, CASE WHEN list_has_any(w.ids, s.earlier) THEN w.ids ELSE list_append(w.ids, s.vec_id) END
  FROM walk w JOIN steps s ON s.i = w.i + 1),
last AS (SELECT ids FROM walk ORDER BY i DESC LIMIT 1)
SELECT vec_id, list_contains(ids, vec_id) AS kept FROM steps, last"""

register("v_greedy_dedup", v_greedy_dedup, _GREEDY_SQL)


# --- feedback over events: traces = 'view', scores = later 'purchase' ---------------
SCORE_HORIZON_S = 7 * 24 * 3600


def fb_first_score_events(spark, sf_dir) -> DataFrame:
    """J6 on events: for each view (trace), the first purchase of the same
    user within 7 days at or after it whose value passes F3 (>= 1.0)."""
    from askwell.operators.asof import first_at_or_after
    from askwell.operators.feedback import POSITIVE_THRESHOLD

    ev = _t(spark, sf_dir).events
    views = ev.filter(F.col("event_type") == "view")
    buys = ev.filter((F.col("event_type") == "purchase") & F.col("value").isNotNull()
                     & (F.col("value") >= POSITIVE_THRESHOLD))
    j = first_at_or_after(
        views, buys, key="user_id", left_id="event_id", left_ts="ts",
        right_id="event_id", right_ts="ts", right_value="value",
        horizon_seconds=SCORE_HORIZON_S, bucket_seconds=6 * 3600,
    )
    # first_at_or_after names the right columns after the inputs; rename
    return j.toDF("trace_id", "user_id", "trace_ts", "score_id", "score_ts", "score_value")


register(
    "fb_first_score_events",
    fb_first_score_events,
    """SELECT trace_id, user_id, trace_ts, score_id, score_ts, score_value FROM (
  SELECT v.event_id AS trace_id, v.user_id, v.ts AS trace_ts, p.event_id AS score_id, p.ts AS score_ts,
         p.value AS score_value,
         row_number() OVER (PARTITION BY v.event_id ORDER BY p.ts, p.event_id) AS rn
  FROM events v JOIN events p
    ON p.user_id = v.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 7 DAY
  WHERE v.event_type = 'view' AND p.event_type = 'purchase'
    AND p.value IS NOT NULL AND p.value >= 1.0) r
WHERE rn = 1""",
)

# --- feedback gates over documents (traces) + labels (human quality scores) --------


def _doc_traces(t: Tables) -> tuple[DataFrame, DataFrame]:
    """documents -> traces (question = SQL = the text), labels -> scores."""
    d = t.documents
    traces = d.select(
        F.col("doc_id").cast("string").alias("trace_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("doc_id"))).alias("ts"),
        F.array(F.lit("question-answering")).alias("tags"),
        F.col("text").alias("input"),
        F.struct(F.col("text").alias("question"), F.col("text").alias("generated_sql")).alias("metadata"),
    )
    scores = t.labels.select(
        F.col("doc_id").cast("string").alias("trace_id"),
        (F.lit("2024-02-01 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("doc_id"))).alias("ts"),
        F.lit("quality").alias("name"),
        F.col("quality").cast("double").alias("value"),
        F.when(F.col("toxic") == 1, F.lit("toxic")).otherwise(F.lit("")).alias("comment"),
    )
    return traces, scores


def fb_first_positive(spark, sf_dir) -> DataFrame:
    """J6 on the trace id: the documents with a positive label, their texts as digests."""
    from askwell.operators.feedback import first_positive

    traces, scores = _doc_traces(_t(spark, sf_dir))
    return first_positive(traces, scores).select(
        "trace_id", F.md5("question").alias("question_md5"), F.md5("generated_sql").alias("sql_md5"),
        "score_value", "score_comment",
    )


register(
    "fb_first_positive",
    fb_first_positive,
    """SELECT CAST(d.doc_id AS VARCHAR) AS trace_id, md5(coalesce(d.text, '')) AS question_md5,
  md5(coalesce(d.text, '')) AS sql_md5, CAST(l.quality AS DOUBLE) AS score_value,
  CASE WHEN l.toxic = 1 THEN 'toxic' ELSE '' END AS score_comment
FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality >= 1""",
)


def fb_feedback_documents(spark, sf_dir) -> DataFrame:
    """ST1: positive labels -> completeness -> write guard -> dedup against
    the benchmark passages (the store) and among earlier accepted documents."""
    from askwell.operators.feedback import process_feedback

    t = _t(spark, sf_dir)
    traces, scores = _doc_traces(t)
    store = t.benchmark.select(F.col("text").alias("question"))
    out = process_feedback(traces, scores, store, threshold=DEDUP_T_TEXT)
    return out.select("trace_id", "seq", "status")


# the sequential loop: gates first, then one candidate a step in arrival order, a
# duplicate if it is near the store or near a candidate approved before it
_FEEDBACK_SQL = f"""WITH RECURSIVE gated AS MATERIALIZED (
  SELECT CAST(d.doc_id AS VARCHAR) AS trace_id, row_number() OVER (ORDER BY d.doc_id) AS seq,
    coalesce(d.text, '') AS text,
    CASE WHEN coalesce(d.text, '') = '' THEN 'skipped'
      WHEN length(regexp_replace(d.text, {_sql_str(_WS)}, '', 'g')) = 0
        OR regexp_matches(d.text, {_sql_str(X.WRITE_PATTERN)}) THEN 'rejected_validation' END AS gate
  FROM documents d JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality >= 1) l ON l.doc_id = d.doc_id),
cand AS MATERIALIZED (SELECT seq, text FROM gated WHERE gate IS NULL),
q AS MATERIALIZED (SELECT * FROM {_term_w_sql('cand', 'seq')} w),
s AS MATERIALIZED (SELECT * FROM {_term_w_sql('benchmark', 'item_id')} w),
stored AS MATERIALIZED (SELECT DISTINCT id FROM (
  SELECT q.id, s.id AS sid FROM q JOIN s ON q.term = s.term GROUP BY q.id, s.id
  HAVING ROUND(SUM(q.w * s.w), 6) >= {DEDUP_T_TEXT}) x),
pairs AS (
  SELECT a.id AS src, b.id AS dst FROM q a JOIN q b ON a.term = b.term AND a.id < b.id GROUP BY a.id, b.id
  HAVING ROUND(SUM(a.w * b.w), 6) >= {DEDUP_T_TEXT}
  UNION SELECT a.seq, b.seq FROM cand a JOIN cand b ON a.text = b.text AND a.seq < b.seq),
near AS MATERIALIZED (SELECT dst, list(src) AS earlier FROM pairs GROUP BY dst),
steps AS MATERIALIZED (
  SELECT c.seq, row_number() OVER (ORDER BY c.seq) AS i, stored.id IS NOT NULL AS in_store,
    coalesce(earlier, []) AS earlier
  FROM cand c LEFT JOIN near ON near.dst = c.seq LEFT JOIN stored ON stored.id = c.seq),
walk(i, ids) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT t.i, CASE WHEN t.in_store OR list_has_any(w.ids, t.earlier) THEN w.ids
    ELSE list_append(w.ids, t.seq) END
  FROM walk w JOIN steps t ON t.i = w.i + 1),
last AS (SELECT ids FROM walk ORDER BY i DESC LIMIT 1),
decided AS (SELECT trace_id, seq, coalesce(gate, CASE WHEN list_contains(ids, seq) THEN 'approved'
  ELSE 'rejected_duplicate' END) AS status FROM gated, last)
"""

register("fb_feedback_documents", fb_feedback_documents, _FEEDBACK_SQL + "SELECT trace_id, seq, status FROM decided")


def fb_validation_gate(spark, sf_dir) -> DataFrame:
    """E9 over whole texts: as they stand, as a comment inside a query over the
    document's source, as a literal inside a query that joins the word after the
    text's first space, and as the rows of a named query."""
    from askwell.functions.sql_scan import validate_texts

    t = _t(spark, sf_dir)
    rows = t.documents.select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"),
                              "text", F.col("source").alias("name")).unionByName(
        t.conversations.select(F.lit("conversation").alias("origin"), F.col("conv_id").alias("id"), "turn", "text",
                               F.col("role").alias("name")))
    text = F.coalesce("text", F.lit(""))
    name = F.coalesce("name", F.lit("nobody"))
    word = F.regexp_extract(text, _SECOND_WORD, 1)
    forms = F.array(*[
        F.struct(F.lit(form).alias("form"), sql.alias("sql")) for form, sql in (
            ("as_is", F.col("text")),
            ("comment", F.concat(F.lit("SELECT doc_id /* "), text, F.lit(" */ FROM documents d, "), name, F.lit(" s;"))),
            ("literal", F.concat(F.lit("SELECT '"), F.replace(text, F.lit("'"), F.lit("''")),
                                 F.lit("' FROM Orders o JOIN \"conversations\" ON o.o_comment IS DISTINCT FROM '' JOIN x"), word)),
            ("named", F.concat(F.lit("WITH "), name, F.lit(" AS (SELECT '"), F.replace(text, F.lit("'"), F.lit("''")),
                               F.lit("' AS reply FROM main.labels) SELECT reply FROM "), name)),
        )
    ])
    texts = rows.select("origin", "id", "turn", F.inline(forms))
    return validate_texts(texts, "sql", _known_tables(spark)).select("origin", "id", "turn", "form", "reason")


_SECOND_WORD = r"^[^ ]* ([\p{L}]*)"


def _gate_sql() -> str:
    from askwell.functions.sql_scan import REASON_TABLE, validation_sql
    from askwell.sources.tables import TABLES

    known = "[" + ", ".join(f"'{n}'" for n in [*TABLES, "customers", "products", "order_items", "reviews"]) + "]"
    e = validation_sql("sql", known)
    quoted = "chr(39) || replace(text, chr(39), chr(39) || chr(39)) || chr(39)"
    return f"""WITH rows AS (
  SELECT 'document' AS origin, doc_id AS id, CAST(0 AS BIGINT) AS turn, text AS raw, coalesce(text, '') AS text,
    coalesce(source, 'nobody') AS name FROM documents
  UNION ALL SELECT 'conversation', conv_id, turn, text, coalesce(text, ''), coalesce(role, 'nobody') FROM conversations),
forms AS (
  SELECT origin, id, turn, 'as_is' AS form, raw AS sql FROM rows
  UNION ALL SELECT origin, id, turn, 'comment', 'SELECT doc_id /* ' || text || ' */ FROM documents d, ' || name || ' s;' FROM rows
  UNION ALL SELECT origin, id, turn, 'literal', 'SELECT ' || {quoted} || ' FROM Orders o JOIN "conversations" ON o.o_comment IS DISTINCT FROM '
    || chr(39) || chr(39) || ' JOIN x' || regexp_extract(text, {_sql_str(_SECOND_WORD)}, 1) FROM rows
  UNION ALL SELECT origin, id, turn, 'named', 'WITH ' || name || ' AS (SELECT ' || {quoted} || ' AS reply FROM main.labels) SELECT reply FROM ' || name FROM rows),
b AS (SELECT *, {e['blank']} AS blank FROM forms),
c AS (SELECT *, {e['cheap']} AS cheap FROM b)
SELECT origin, id, turn, form, coalesce(cheap, {_sql_str(REASON_TABLE)} || {e['unknown']}) AS reason FROM c"""


register("fb_validation_gate", fb_validation_gate, _gate_sql())


def fb_gate_stats(spark, sf_dir) -> DataFrame:
    from askwell.operators.feedback import gate_stats, process_feedback

    t = _t(spark, sf_dir)
    traces, scores = _doc_traces(t)
    store = t.benchmark.select(F.col("text").alias("question"))
    return gate_stats(process_feedback(traces, scores, store, threshold=DEDUP_T_TEXT))


register(
    "fb_gate_stats",
    fb_gate_stats,
    _FEEDBACK_SQL + "SELECT " + ", ".join(
        f"COUNT(*) FILTER (WHERE status = '{s}') AS {s}"
        for s in ("approved", "rejected_validation", "rejected_duplicate", "skipped")
    ) + " FROM decided",
)


# --- selection strategies: benchmark passages = questions, documents = pool --------


def _pool(t: Tables) -> tuple[DataFrame, DataFrame]:
    questions = t.benchmark.select(F.col("item_id").alias("q_id"))
    pool = t.documents.select(
        F.col("doc_id").alias("example_id"), F.md5(F.coalesce("text", F.lit(""))).alias("question"),
        F.concat_ws(":", "lang", "source").alias("sql_query"),
    )
    return questions, pool


def _listed(selected: DataFrame) -> DataFrame:
    return selected.select("q_id", F.posexplode("examples").alias("at", "e")).select(
        "q_id", (F.col("at") + 1).cast("bigint").alias("rank"), "e.question", "e.sql_query"
    )


def sel_static(spark, sf_dir) -> DataFrame:
    """The first documents for every passage."""
    from askwell.operators.memory import select_static

    return _listed(select_static(*_pool(_t(spark, sf_dir))))


def sel_random(spark, sf_dir) -> DataFrame:
    """Documents drawn for each passage, by position in id order."""
    from askwell.operators.memory import select_random

    return _listed(select_random(*_pool(_t(spark, sf_dir))))


_POOL_SQL = """pool AS (SELECT row_number() OVER (ORDER BY doc_id) AS place, md5(coalesce(text, '')) AS question,
  concat_ws(':', lang, source) AS sql_query FROM documents)"""

register(
    "sel_static",
    sel_static,
    f"""WITH {_POOL_SQL}
SELECT item_id AS q_id, place AS rank, question, sql_query FROM benchmark, pool WHERE place <= {FEW_SHOT_K}""",
)
# three draws, written out one after the other
register(
    "sel_random",
    sel_random,
    f"""WITH {_POOL_SQL}, size AS (SELECT COUNT(*) AS n FROM documents),
h AS (SELECT item_id AS q_id, n, {', '.join(
        f"CAST('0x' || substr(md5('{RANDOM_SEED}|' || item_id || '|{i}'), 1, 15) AS BIGINT) % (n - {2 - i}) AS t{i}"
        for i in range(3))} FROM benchmark, size),
one AS (SELECT q_id, n, t0 AS p0, CASE WHEN t1 = t0 THEN n - 2 ELSE t1 END AS p1, t2 FROM h),
two AS (SELECT q_id, p0, p1, CASE WHEN t2 IN (p0, p1) THEN n - 1 ELSE t2 END AS p2 FROM one),
drawn AS (SELECT q_id, CAST(1 AS BIGINT) AS rank, p0 AS p FROM two UNION ALL SELECT q_id, 2, p1 FROM two
  UNION ALL SELECT q_id, 3, p2 FROM two)
SELECT q_id, rank, question, sql_query FROM drawn JOIN pool ON place = p + 1""",
)


# Vectors of one class are the seed, the others are asked in the order of their ids;
# those whose document is labelled good were answered right.
SEED_CLASS = 0


def sel_dynamic_feedback(spark, sf_dir) -> DataFrame:
    """The examples that each question sees in a store that grows as answers come."""
    from askwell.operators.memory import select_dynamic_feedback

    t = _t(spark, sf_dir)
    text = F.col("vec_id").cast("string")
    good = t.labels.filter(F.col("quality") == 1).select(F.col("doc_id").alias("vec_id")).distinct().withColumn("good", F.lit(True))
    is_seed = F.coalesce(F.col("label") == SEED_CLASS, F.lit(False))
    seed = t.embeddings.filter(is_seed).select(
        F.col("vec_id").alias("example_id"), text.alias("question"), F.lit("seed").alias("sql_query"), "embedding"
    )
    asked = t.embeddings.filter(~is_seed).join(good, "vec_id", "left").select(
        F.col("vec_id").alias("q_id"), F.col("vec_id").alias("seq"), text.alias("question"),
        F.lit("learned").alias("gold_sql"), F.coalesce("good", F.lit(False)).alias("correct"), "embedding",
    )
    return _listed(select_dynamic_feedback(asked, seed, FEW_SHOT_K, DEDUP_T_EMB))


# right answers one at a time in their order: each is learned unless near the seed or a learned one
register(
    "sel_dynamic_feedback",
    sel_dynamic_feedback,
    f"""WITH RECURSIVE near AS MATERIALIZED (SELECT * FROM {_EMB_PAIRS} p),
v AS MATERIALIZED (SELECT vec_id AS id, coalesce(label = {SEED_CLASS}, false) AS is_seed FROM embeddings),
fresh AS MATERIALIZED (
  SELECT v.id, row_number() OVER (ORDER BY v.id) AS i,
    coalesce((SELECT list(s_id) FROM near WHERE q_id = v.id AND s_id < v.id AND similarity >= {DEDUP_T_EMB}), []) AS earlier
  FROM v WHERE NOT is_seed AND id IN (SELECT doc_id FROM labels WHERE quality = 1)
    AND NOT EXISTS (SELECT 1 FROM near JOIN v s ON s.id = s_id AND s.is_seed WHERE q_id = v.id AND similarity >= {DEDUP_T_EMB})),
walk(i, ids) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT f.i, CASE WHEN list_has_any(w.ids, f.earlier) THEN w.ids ELSE list_append(w.ids, f.id) END
  FROM walk w JOIN fresh f ON f.i = w.i + 1),
learned AS (SELECT unnest(ids) AS id FROM (SELECT ids FROM walk ORDER BY i DESC LIMIT 1)),
store AS (SELECT id, true AS is_seed FROM v WHERE is_seed UNION ALL SELECT id, false FROM learned)
SELECT q_id, rank, CAST(s_id AS VARCHAR) AS question, CASE WHEN is_seed THEN 'seed' ELSE 'learned' END AS sql_query FROM (
  SELECT q_id, s_id, store.is_seed,
    CAST(row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, store.is_seed DESC, s_id) AS BIGINT) AS rank
  FROM near JOIN v q ON q.id = q_id AND NOT q.is_seed JOIN store ON store.id = s_id
  WHERE store.is_seed OR s_id < q_id) r WHERE rank <= {FEW_SHOT_K}""",
)


# --- profiles (P1, P3, A14) on the driver tables -------------------------------------

_KEY_CANDIDATES = {
    "customer": ["c_custkey"], "orders": ["o_orderkey", "o_custkey"], "part": ["p_partkey"],
    "supplier": ["s_suppkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"],
    "lineitem": ["l_orderkey"], "documents": ["doc_id"], "embeddings": ["vec_id"], "events": ["event_id"],
}
_FKS = [
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("labels", "doc_id", "documents", "doc_id"),
]


def _all_tables(spark, sf_dir) -> dict[str, DataFrame]:
    from askwell.sources.tables import TABLES

    t = _t(spark, sf_dir)
    return {n: getattr(t, n) for n in TABLES}


def p_row_counts(spark, sf_dir) -> DataFrame:
    from askwell.operators.profile import row_counts

    return row_counts(_all_tables(spark, sf_dir))


def _row_counts_sql() -> str:
    from askwell.sources.tables import TABLES

    return " UNION ALL ".join(f"SELECT '{n}' AS table_name, COUNT(*) AS row_count FROM {n}" for n in TABLES)


register("p_row_counts", p_row_counts, _row_counts_sql())


def p_key_profile(spark, sf_dir) -> DataFrame:
    from askwell.operators.profile import key_profile

    return key_profile(_all_tables(spark, sf_dir), _KEY_CANDIDATES)


register(
    "p_key_profile",
    p_key_profile,
    " UNION ALL ".join(
        f"""SELECT '{tb}' AS table_name, '{c}' AS column_name, COUNT(*) AS row_count,
  COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count, COUNT(DISTINCT {c}) AS distinct_count,
  (COUNT(*) FILTER (WHERE {c} IS NULL) = 0 AND COUNT(DISTINCT {c}) = COUNT(*)) AS is_key FROM {tb}"""
        for tb, cols in _KEY_CANDIDATES.items() for c in cols
    ),
)


def p_foreign_keys(spark, sf_dir) -> DataFrame:
    from askwell.operators.profile import foreign_key_profile

    return foreign_key_profile(_all_tables(spark, sf_dir), _FKS)


register(
    "p_foreign_keys",
    p_foreign_keys,
    " UNION ALL ".join(
        f"""SELECT '{ch}' AS child, '{c}' AS column_name, '{pa}' AS parent, '{pc}' AS parent_column,
  COUNT(*) AS orphans, COUNT(*) = 0 AS holds
FROM {ch} x WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {pa} y WHERE y.{pc} = x.{c})"""
        for ch, c, pa, pc in _FKS
    ),
)


def p_table_profiles(spark, sf_dir) -> DataFrame:
    from askwell.operators.profile import table_profiles

    p = table_profiles(spark, _all_tables(spark, sf_dir))

    def each(field: str):
        return F.transform("columns", lambda c: c[field].cast("string"))

    return p.select("table_name", "ddl", each("name").alias("names"), each("type").alias("types"),
                    each("nullable").alias("nullable"), each("comment").alias("comments"),
                    F.map_values("column_descriptions").alias("descriptions"), "sample_rows", "row_count")


# the driver tables as Parquet states them: name and Spark type of each column
_COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _profile_sql(name: str) -> str:
    from askwell.operators.profile import SAMPLE_ROWS, ddl_text

    fields = [tuple(c.split(" ")) for c in _COLUMNS[name].split(", ")]
    decimal = "CAST(CAST(ROUND({0}, 4) AS DECIMAL(38,4)) AS VARCHAR)"
    shown = {
        "double": decimal,
        "array<float>": f"'[' || array_to_string(list_transform({{0}}, lambda v: {decimal.format('v')}), ', ') || ']'",
        "string": "{0}",
    }
    cells = ", ".join(f"'{c}', " + shown.get(t, "CAST({0} AS VARCHAR)").format(c) for c, t in fields)
    keys = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c, t in fields if t in ("int", "bigint"))

    def texts(values) -> str:
        return "[" + ", ".join(_sql_str(v) for v in values) + "]"

    blank = texts("" for _ in fields)
    return f"""SELECT '{name}' AS table_name, {_sql_str(ddl_text(name, fields))} AS ddl,
  {texts(c for c, _ in fields)} AS names, {texts(t for _, t in fields)} AS types, {texts('true' for _ in fields)} AS nullable,
  {blank} AS comments, {blank} AS descriptions,
  (SELECT list(r ORDER BY h, r) FROM (SELECT md5({keys}) AS h, CAST(json_object({cells}) AS VARCHAR) AS r
    FROM {name} ORDER BY h, r LIMIT {SAMPLE_ROWS}) x) AS sample_rows,
  (SELECT COUNT(*) FROM {name}) AS row_count"""


register("p_table_profiles", p_table_profiles, "\nUNION ALL\n".join(_profile_sql(n) for n in _COLUMNS))


# --- memory chain: benchmark questions x documents as the example store --------------
#   example question = document text, example SQL = document source, no explanation


def _schema_blocks_spark(spark, sf_dir):
    from askwell.operators.profile import ddl_text, schema_fields
    from askwell.sources.views import VIEW_FIELDS, Views

    v = Views(_t(spark, sf_dir))
    out = []
    for name in VIEW_FIELDS:
        df = getattr(v, name)
        out.append((name, df.select(F.count(F.lit(1))).scalar(), ddl_text(name, schema_fields(df.schema))))
    return out


def _schema_ddls_static():
    from askwell.operators.profile import ddl_text
    from askwell.sources.views import VIEW_FIELDS

    return [(n, ddl_text(n, f)) for n, f in VIEW_FIELDS.items()]


def _memory_frames(spark, sf_dir):
    from askwell.operators.memory import OVERFETCH, FEW_SHOT_K, budget_select, candidate_costs

    t = _t(spark, sf_dir)
    questions = t.benchmark.select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))
    store = t.documents.select(
        F.col("doc_id").alias("example_id"), F.col("text").alias("question"),
        F.col("source").alias("sql_query"), F.lit("").alias("explanation"),
    )
    near = TS.text_topk(questions, store, FEW_SHOT_K * OVERFETCH, q_id="q_id", q_text="question",
                        s_id="example_id", s_text="question")
    cands = candidate_costs(near.select("q_id", "rank", "s_id"), store)
    st = None
    for _, ddl in _schema_ddls_static():
        c = X.count_tokens(F.lit(ddl))
        st = c if st is None else st + c
    chosen = budget_select(cands, questions, schema_tokens_col=st)
    return questions, store, chosen


def mem_budget_select(spark, sf_dir) -> DataFrame:
    _, _, chosen = _memory_frames(spark, sf_dir)
    return chosen.select("q_id", "rank", "s_id", "cost", "running_cost", "remaining")


def _tok_sql(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, {_sql_str(_TOK)}))"


def _budget_sql() -> str:
    schema_tok = " + ".join(_tok_sql(_sql_str(d)) for _, d in _schema_ddls_static())
    return f"""topk AS {_TOPK_DOCS_SQL},
cost AS (SELECT t.q_id, t.rank, t.s_id,
    {_tok_sql("'Question: ' || coalesce(d.text, '') || chr(10) || 'SQL: ' || coalesce(d.source, '')")} + 10 AS cost
  FROM topk t JOIN documents d ON d.doc_id = t.s_id),
q AS (SELECT item_id AS q_id, text AS question,
    3500 - 500 - ({schema_tok}) - {_tok_sql("coalesce(text, '')")} AS remaining FROM benchmark),
run AS (SELECT c.q_id, c.rank, c.s_id, CAST(c.cost AS INTEGER) AS cost,
    CAST(SUM(c.cost) OVER (PARTITION BY c.q_id ORDER BY c.rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running_cost,
    CAST(q.remaining AS INTEGER) AS remaining
  FROM cost c JOIN q ON q.q_id = c.q_id),
chosen AS (SELECT * FROM run WHERE remaining > 0 AND running_cost <= remaining AND rank <= 3)"""


register(
    "mem_budget_select",
    mem_budget_select,
    f"WITH {_budget_sql()}\nSELECT q_id, rank, s_id, cost, running_cost, remaining FROM chosen",
)


def mem_prompts(spark, sf_dir) -> DataFrame:
    from askwell.operators.memory import attach_examples, build_prompts, schema_section_col

    questions, store, chosen = _memory_frames(spark, sf_dir)
    examples = attach_examples(chosen.select("q_id", "rank", "s_id"), store)
    schema = schema_section_col(_schema_blocks_spark(spark, sf_dir))
    return build_prompts(questions, examples, schema).select("q_id", "n_examples", "tokens", "user")


def _prompts_sql() -> str:
    from askwell.operators.memory import (
        BEHAVIORAL_HEAD, EXECUTIVE_HEAD, EXECUTIVE_TAIL, KNOWLEDGE_HEAD, SYSTEM_PROMPT,
    )
    from askwell.sources.views import ORACLE_VIEWS

    blocks = []
    for i, (name, ddl) in enumerate(_schema_ddls_static()):
        blocks.append(
            (f"chr(10) || " if i else "")
            + f"{_sql_str(f'-- Table: {name}  (')} || CAST((SELECT COUNT(*) FROM {name}) AS VARCHAR) || "
            + _sql_str(f" rows)\n{ddl}\n")
        )
    knowledge = f"{_sql_str(KNOWLEDGE_HEAD)} || " + " || ".join(blocks) + " || chr(10)"
    views = ORACLE_VIEWS.strip()[len("WITH"):]
    return f"""WITH {views.strip()},
{_budget_sql()},
ex AS (SELECT c.q_id, COUNT(*) AS n,
    string_agg('Question: ' || d.text || chr(10) || 'SQL:' || chr(10) || d.source || chr(10), chr(10) ORDER BY c.rank) AS body
  FROM chosen c JOIN documents d ON d.doc_id = c.s_id GROUP BY c.q_id),
u AS (SELECT q.q_id, coalesce(ex.n, 0) AS n,
    concat_ws(chr(10),
      CASE WHEN ex.n > 0 THEN {_sql_str(BEHAVIORAL_HEAD)} || ex.body || chr(10) END,
      {knowledge},
      {_sql_str(EXECUTIVE_HEAD)} || q.question || {_sql_str(EXECUTIVE_TAIL)}) AS "user"
  FROM q LEFT JOIN ex ON ex.q_id = q.q_id)
SELECT q_id, CAST(n AS INTEGER) AS n_examples,
  CAST({_tok_sql(_sql_str(SYSTEM_PROMPT))} + {_tok_sql('"user"')} AS INTEGER) AS tokens, "user"
FROM u"""


register("mem_prompts", mem_prompts, _prompts_sql())
