"""The registered corpus queries: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from tessera.llm import chat, exact_dedup, line_dedup, minhash, mixing, packing, quality_model, quality_rules, repair, resharding, spelling, suffix_dedup, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_chat_format": chat.op2_chat_format,
    "op3_packing": packing.op3_packing,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_quality_model": quality_model.op5_quality_model,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_mixing": mixing.op7_mixing,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_minhash": minhash.op10_minhash,
    "op11_spelling": spelling.op11_spelling,
    "op12_resharding": resharding.op12_resharding,
    "op13_conversation_repair": repair.op13_conversation_repair,
}

ORACLES = {
    "op2_chat_format": chat.OP2_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
}
