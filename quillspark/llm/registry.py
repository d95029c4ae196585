"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from quillspark.llm.byte_bpe import op10_query
from quillspark.llm.language_model import op6_query
from quillspark.llm.line_dedup import OP7_SQL, op7_query
from quillspark.llm.mixing import op2_query
from quillspark.llm.near_dedup import op9_query
from quillspark.llm.quality_classifier import op3_query
from quillspark.llm.quality_rules import OP8_SQL, op8_query
from quillspark.llm.suffix_dedup import OP4_SQL, op4_query
from quillspark.llm.top_k import OP1_SQL, op1_query
from quillspark.llm.toxicity import op5_query


def queries() -> dict:
    return {
        "op1_top_k": op1_query,
        "op2_mixing": op2_query,
        "op3_quality_classifier": op3_query,
        "op4_suffix_dedup": op4_query,
        "op5_toxicity": op5_query,
        "op6_language_model": op6_query,
        "op7_line_dedup": op7_query,
        "op8_quality_rules": op8_query,
        "op9_near_dedup": op9_query,
        "op10_byte_bpe": op10_query,
    }


def oracle_sql() -> dict:
    return {"op1_top_k": OP1_SQL, "op4_suffix_dedup": OP4_SQL, "op7_line_dedup": OP7_SQL, "op8_quality_rules": OP8_SQL}
