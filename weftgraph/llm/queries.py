"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from weftgraph.llm import chat, embdedup, langid, mixing, pieces, pii, quality, simhash, topk, toxicity

QUERIES = {
    "op5_pii": pii.op5_pii,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op7_embedding_near_dedup": embdedup.op7_embedding_near_dedup,
    "op2_exact_top_k": topk.op2_exact_top_k,
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op6_mixing": mixing.op6_mixing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_language_id": langid.op10_language_id,
}

SQL: dict[str, str] = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op2_exact_top_k": topk.OP2_SQL,
    "op7_embedding_near_dedup": embdedup.OP7_SQL,
}
