"""Queries and SQL of this subpackage, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat_format import OP2_SQL, op2_chat_format
from .decontamination import OP8_SQL, op8_decontamination
from .exact_dedup import OP3_SQL, op3_exact_dedup
from .html_extraction import op10_html_extraction
from .language_id import op4_language_id
from .mixing import op6_source_mixing
from .periodic_runs import op12_periodic_runs
from .simhash import op1_simhash
from .spelling_variants import OP11_SQL, op11_spelling_variants
from .substring_dedup import op9_substring_dedup
from .suffix_dedup import op13_suffix_dedup
from .token_counts import op5_token_counts
from .toxicity import op7_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_simhash, op2_chat_format, op3_exact_dedup, op4_language_id, op5_token_counts, op6_source_mixing, op7_toxicity, op8_decontamination, op9_substring_dedup, op10_html_extraction,
        op11_spelling_variants, op12_periodic_runs, op13_suffix_dedup)}

SQL: dict[str, str] = {"op2_chat_format": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op8_decontamination": OP8_SQL, "op11_spelling_variants": OP11_SQL}
