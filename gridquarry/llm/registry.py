"""Queries of this subpackage and the DuckDB SQL for those that SQL can express."""

import corpus_pipeline
from gridquarry.llm.embedding_dedup import op10_embedding_dedup
from gridquarry.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from gridquarry.llm.language_id import op4_language_id
from gridquarry.llm.line_dedup import op1_line_dedup
from gridquarry.llm.mixing import op2_mixing
from gridquarry.llm.near_dedup import OP9_SQL, op9_near_dedup
from gridquarry.llm.packing import op7_packing
from gridquarry.llm.substring_dedup import OP5_SQL, op5_substring_dedup
from gridquarry.llm.suffix_dedup import op3_suffix_dedup
from gridquarry.llm.url_filter import OP6_SQL, op6_url_filter


def queries() -> dict:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_mixing": op2_mixing,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_language_id": op4_language_id,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_url_filter": op6_url_filter,
        "op7_packing": op7_packing,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_near_dedup": op9_near_dedup,
        "op10_embedding_dedup": op10_embedding_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracles() -> dict:
    found = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return found | {
        "op5_substring_dedup": OP5_SQL,
        "op6_url_filter": OP6_SQL,
        "op8_exact_dedup": OP8_SQL,
        "op9_near_dedup": OP9_SQL,
    }
