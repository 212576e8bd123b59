"""The text operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from .chat import OP2_SQL, op2_chat_formatting
from .decontamination import op6_benchmark_decontamination
from .html import op3_html_extraction
from .ngram_join import op1_ngram_jaccard_join
from .packing import op8_packing
from .pii import op9_pii
from .sharding import op7_sharding
from .token_counts import op4_token_counts
from .topk import OP5_SQL, op5_top_k
from .toxicity import op10_toxicity

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_html_extraction": op3_html_extraction,
    "op4_token_counts": op4_token_counts,
    "op5_top_k": op5_top_k,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_pii": op9_pii,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL: dict[str, str] = {"op2_chat_formatting": OP2_SQL, "op5_top_k": OP5_SQL}
