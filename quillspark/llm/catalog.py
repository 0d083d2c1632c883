"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from quillspark.llm import bpe, chat, classify, embeddings, lines, lm, minhash, mixing, topk

QUERIES = {
    f.__name__: f
    for f in (
        minhash.op1_minhash_near_dedup, classify.op2_quality_classifier, embeddings.op3_embedding_near_dedup, classify.op4_toxicity, lm.op5_lm_scoring,
        mixing.op6_mixing, lines.op7_line_dedup, bpe.op8_byte_bpe, chat.op9_chat_formatting, topk.op10_exact_top_k,
    )
}

SQL = {"op6_mixing": mixing.OP6_SQL, "op7_line_dedup": lines.OP7_SQL, "op9_chat_formatting": chat.OP9_SQL, "op10_exact_top_k": topk.OP10_SQL}
