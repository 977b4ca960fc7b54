"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, infill, mixing, near_dedup, passages, pieces, quality, ranked, repeats, revisits, sharding, toxicity

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_revisit_asof": revisits.op2_revisit_asof,
    "op3_compact_windows": passages.op3_compact_windows,
    "op4_bottomk_near_dedup": near_dedup.op4_bottomk_near_dedup,
    "op5_relational_chat": chat.op5_relational_chat,
    "op6_subword_toxicity": toxicity.op6_subword_toxicity,
    "op7_radix_repeats": repeats.op7_radix_repeats,
    "op8_pareto_mix": mixing.op8_pareto_mix,
    "op9_feistel_shards": sharding.op9_feistel_shards,
    "op10_spaced_seeds": decontaminate.op10_spaced_seeds,
    "op11_threshold_search": ranked.op11_threshold_search,
    "op12_fill_in_middle": infill.op12_fill_in_middle,
    "op13_piece_round_trip": pieces.op13_piece_round_trip,
}

ORACLE_SQL = {
    "op1_quality_rules": quality.OP1_SQL,
    "op2_revisit_asof": revisits.OP2_SQL,
    "op4_bottomk_near_dedup": near_dedup.OP4_SQL,
    "op5_relational_chat": chat.OP5_SQL,
    "op7_radix_repeats": repeats.OP7_SQL,
    "op9_feistel_shards": sharding.OP9_SQL,
    "op10_spaced_seeds": decontaminate.OP10_SQL,
    "op11_threshold_search": ranked.OP11_SQL,
    "op12_fill_in_middle": infill.OP12_SQL,
}
