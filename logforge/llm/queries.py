"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from logforge.llm.byte_bpe import op9_byte_bpe
from logforge.llm.decontaminate import op8_decontaminate
from logforge.llm.embedding_dedup import op3_embedding_dedup, op3_sql
from logforge.llm.language_id import op12_language_id
from logforge.llm.license_scan import op5_license_scan
from logforge.llm.line_dedup import op6_line_dedup, op6_sql
from logforge.llm.quality import op2_quality
from logforge.llm.simhash import op10_simhash
from logforge.llm.spelling import op11_spelling, op11_sql
from logforge.llm.token_alignment import op13_token_alignment
from logforge.llm.token_counts import op1_token_counts
from logforge.llm.toxicity import op7_toxicity
from logforge.llm.url_filter import op4_sql, op4_url_filter


def queries() -> dict:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_quality": op2_quality,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_url_filter": op4_url_filter,
        "op5_license_scan": op5_license_scan,
        "op6_line_dedup": op6_line_dedup,
        "op7_toxicity": op7_toxicity,
        "op8_decontaminate": op8_decontaminate,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_simhash": op10_simhash,
        "op11_spelling": op11_spelling,
        "op12_language_id": op12_language_id,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": op3_sql(), "op4_url_filter": op4_sql(), "op6_line_dedup": op6_sql(), "op11_spelling": op11_sql()}
