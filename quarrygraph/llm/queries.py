"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op1_bpe
from .chat import OP4_SQL, op4_chat_formatting
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .language import op5_language_id
from .packing import op3_best_fit_packing
from .quality import OP8_SQL, op8_quality_rules
from .simhash import op9_simhash_near_dedup
from .suffix_dedup import op2_suffix_array_dedup
from .token_counts import op7_token_counts
from .url_filter import op6_url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_suffix_array_dedup": op2_suffix_array_dedup,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_chat_formatting": op4_chat_formatting,
        "op5_language_id": op5_language_id,
        "op6_url_filters": op6_url_filters,
        "op7_token_counts": op7_token_counts,
        "op8_quality_rules": op8_quality_rules,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_exact_dedup": op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_formatting": OP4_SQL, "op8_quality_rules": OP8_SQL, "op10_exact_dedup": OP10_SQL}
