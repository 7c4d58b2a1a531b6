"""The queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from lumiform.llm.bagminhash import op3_near_dedup
from lumiform.llm.chat import OP7_SQL, op7_chat
from lumiform.llm.decontam import op4_decontamination
from lumiform.llm.hardneg import OP11_SQL, op11_hard_negatives
from lumiform.llm.html import op6_html
from lumiform.llm.langid import op12_language
from lumiform.llm.lines import OP10_SQL, op10_line_dedup
from lumiform.llm.packing import op5_packing
from lumiform.llm.suffix import OP8_SQL, op8_suffix_dedup
from lumiform.llm.tiff import op1_tiff
from lumiform.llm.tokens import op9_token_counts
from lumiform.llm.toxicity import op2_toxicity
from lumiform.llm.variants import OP13_SQL, op13_variants

QUERIES = {
    "op1_tiff": op1_tiff,
    "op2_toxicity": op2_toxicity,
    "op3_near_dedup": op3_near_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_packing": op5_packing,
    "op6_html": op6_html,
    "op7_chat": op7_chat,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_line_dedup": op10_line_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_language": op12_language,
    "op13_variants": op13_variants,
}

ORACLE = {
    "op7_chat": OP7_SQL,
    "op8_suffix_dedup": OP8_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op13_variants": OP13_SQL,
}
