"""Registry of the subpackage's queries and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from askwell.llm.bpe import op2_query
from askwell.llm.codes import OP11_SQL, op11_query
from askwell.llm.divergence import OP13_SQL, op13_query
from askwell.llm.neighbours import op5_query
from askwell.llm.packing import op1_query
from askwell.llm.pieces import op12_query
from askwell.llm.pii import op3_query
from askwell.llm.quality import op7_query
from askwell.llm.secrets import op4_query
from askwell.llm.simhash import op10_query
from askwell.llm.suffix_dedup import op6_query
from askwell.llm.toxicity import op9_query
from askwell.llm.warc import op8_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_query,
    "op2_bpe": op2_query,
    "op3_pii": op3_query,
    "op4_secrets": op4_query,
    "op5_nearest_neighbours": op5_query,
    "op6_suffix_dedup": op6_query,
    "op7_quality_rules": op7_query,
    "op8_warc": op8_query,
    "op9_toxicity": op9_query,
    "op10_simhash": op10_query,
    "op11_vector_codes": op11_query,
    "op12_sentencepiece": op12_query,
    "op13_source_divergence": op13_query,
}

ORACLES: dict[str, str] = {
    "op11_vector_codes": OP11_SQL,
    "op13_source_divergence": OP13_SQL,
}
