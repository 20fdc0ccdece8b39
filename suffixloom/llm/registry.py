"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import bpe, chat, decontaminate, langid, negatives, quality, sharding, simhash, spelling, substring, tokencount, toxicity, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_token_counts": tokencount.op2_token_counts,
    "op3_warc": warc.op3_warc,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_langid": langid.op5_langid,
    "op6_substring": substring.op6_substring,
    "op7_quality": quality.op7_quality,
    "op8_bpe": bpe.op8_bpe,
    "op9_simhash": simhash.op9_simhash,
    "op10_chat": chat.op10_chat,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_negatives": negatives.op12_negatives,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE_SQL = {
    "op3_warc": warc.OP3_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op7_quality": quality.OP7_SQL,
    "op10_chat": chat.OP10_SQL,
    "op12_negatives": negatives.OP12_SQL,
    "op13_spelling": spelling.OP13_SQL,
}
