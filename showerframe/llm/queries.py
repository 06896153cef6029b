"""The named queries of the training-data operators: one per operator over its whole table, and the pipeline."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from showerframe.llm import url_filter, vector_codes
from showerframe.llm.alignment import op12_alignment
from showerframe.llm.decontaminate import op4_decontaminate
from showerframe.llm.html_text import op2_html_text
from showerframe.llm.language_id import op1_language_id
from showerframe.llm.lm_score import op8_lm_score
from showerframe.llm.near_dedup import op6_near_dedup
from showerframe.llm.packing import op5_packing
from showerframe.llm.pieces import op13_sentencepiece
from showerframe.llm.quality import op7_quality_rules
from showerframe.llm.shipping import shipped
from showerframe.llm.suffix_array import op10_suffix_array
from showerframe.llm.suffix_tree import op3_suffix_tree
from showerframe.llm.url_filter import op9_url_filter
from showerframe.llm.vector_codes import op11_vector_codes

_QUERIES = (op1_language_id, op2_html_text, op3_suffix_tree, op4_decontaminate, op5_packing, op6_near_dedup, op7_quality_rules, op8_lm_score, op9_url_filter, op10_suffix_array,
            op11_vector_codes, op12_alignment, op13_sentencepiece)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: shipped(f) for f in _QUERIES} | {"pipeline": shipped(corpus_pipeline.run)}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express on whole tables; tests hold the others against brute force."""
    return {"op9_url_filter": url_filter.SQL, "op11_vector_codes": vector_codes.oracle_sql()}
