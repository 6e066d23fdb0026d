"""The opN_ queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontaminate, line_dedup, quality, url_filters
from brindle.llm.decontaminate import op3_decontaminate
from brindle.llm.line_dedup import op10_line_dedup
from brindle.llm.lm_scores import op4_lm_scores
from brindle.llm.near_dedup import op9_near_dedup
from brindle.llm.packing import op1_packing
from brindle.llm.quality import op8_quality_rules
from brindle.llm.sharding import op6_sharding
from brindle.llm.suffix_dedup import op2_suffix_dedup
from brindle.llm.token_counts import op7_token_counts
from brindle.llm.url_filters import op5_url_filters

_QUERIES = [
    op1_packing,
    op2_suffix_dedup,
    op3_decontaminate,
    op4_lm_scores,
    op5_url_filters,
    op6_sharding,
    op7_token_counts,
    op8_quality_rules,
    op9_near_dedup,
    op10_line_dedup,
]
_ORACLES: dict[str, str] = {
    "op3_decontaminate": decontaminate.ORACLE,
    "op5_url_filters": url_filters.ORACLE,
    "op8_quality_rules": quality.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
