"""The registered queries of this package and their SQL twins, by name."""

from __future__ import annotations

from . import (
    conversations,
    exact_dedup,
    html_text,
    jaccard_join,
    minhash,
    mixing,
    pieces,
    pii,
    quality_rules,
    shard,
    substring_dedup,
    warc,
    whitening,
)

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_html_text": html_text.op3_html_text,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_warc": warc.op6_warc,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_pii": pii.op8_pii,
    "op9_pieces": pieces.op9_pieces,
    "op10_shard": shard.op10_shard,
    "op11_conversations": conversations.op11_conversations,
    "op12_whitening": whitening.op12_whitening,
    "op13_minhash": minhash.op13_minhash,
}

SQL = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op5_jaccard_join": jaccard_join.SQL,
    "op6_warc": warc.SQL,
    "op11_conversations": conversations.SQL,
    "op13_minhash": minhash.SQL,
}
