"""Queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

import corpus_pipeline
from tarnwork.llm import chat, exact_dedup, html_text, katz, licences, mixing, neighbours, packing, simhash, toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_html_text": html_text.op1_html_text,
    "op2_licences": licences.op2_licences,
    "op3_chat": chat.op3_chat,
    "op4_mixing": mixing.op4_mixing,
    "op5_packing": packing.op5_packing,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_neighbours": neighbours.op7_neighbours,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_katz": katz.op9_katz,
    "op10_simhash": simhash.op10_simhash,
}
ORACLES = {"op6_exact_dedup": exact_dedup.ORACLE}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
