"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, brown, chat, decontam, jaccard, main_text, prefix_trie, sharding, spelling, token_counts, topk, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_brown": brown.op2_brown,
        "op3_topk": topk.op3_topk,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_bpe": bpe.op5_bpe,
        "op6_chat_format": chat.op6_chat_format,
        "op7_sharding": sharding.op7_sharding,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_decontam": decontam.op9_decontam,
        "op10_jaccard_join": jaccard.op10_jaccard_join,
        "op11_main_text": main_text.op11_main_text,
        "op12_spelling": spelling.op12_spelling,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return topk.ORACLE | url_filter.ORACLE | chat.ORACLE | sharding.ORACLE | token_counts.ORACLE | decontam.ORACLE | jaccard.ORACLE | main_text.ORACLE | spelling.ORACLE | prefix_trie.ORACLE
