"""Queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from protolake.llm.langid import op10_language_id
from protolake.llm.licenses import OP6_SQL, op6_license_scan
from protolake.llm.minhash import op3_minhash_dedup
from protolake.llm.mixing import op2_source_mix
from protolake.llm.packing import op5_best_fit_packing
from protolake.llm.quality import OP9_SQL, op9_quality_rules
from protolake.llm.separators import op8_separator_scan
from protolake.llm.token_files import op4_token_files
from protolake.llm.topk import OP7_SQL, op7_top_k
from protolake.llm.toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_source_mix": op2_source_mix,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_token_files": op4_token_files,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_license_scan": op6_license_scan,
    "op7_top_k": op7_top_k,
    "op8_separator_scan": op8_separator_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
}

ORACLES: dict[str, str] = {
    "op6_license_scan": OP6_SQL,
    "op7_top_k": OP7_SQL,
    "op9_quality_rules": OP9_SQL,
}
