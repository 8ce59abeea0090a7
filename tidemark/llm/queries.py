"""The registered queries of this folder and, where SQL can say them, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import op3_byte_bpe
from tidemark.llm.chat import OP4_SQL, op4_chat_format
from tidemark.llm.counting import op8_token_counts
from tidemark.llm.fingerprints import op1_fingerprints
from tidemark.llm.language import op6_language_id
from tidemark.llm.lines import op2_line_dedup
from tidemark.llm.neardup import op10_minhash_near_dedup
from tidemark.llm.negatives import OP11_SQL, op11_hard_negatives
from tidemark.llm.packing import op5_best_fit_packing
from tidemark.llm.pages import op9_html_extraction
from tidemark.llm.phrases import OP12_SQL, op12_collocations
from tidemark.llm.shards import op13_shards
from tidemark.llm.vectors import OP7_SQL, op7_embedding_near_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_line_dedup": op2_line_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_chat_format": op4_chat_format,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_language_id": op6_language_id,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_html_extraction": op9_html_extraction,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_collocations": op12_collocations,
    "op13_shards": op13_shards,
}

ORACLES: dict[str, str] = {"op4_chat_format": OP4_SQL, "op7_embedding_near_dedup": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op12_collocations": OP12_SQL}
