"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from viatica.llm import language, lines, lm, media, mixing, negatives, neighbours, packing, quality, simhash, tokencount, toxicity, trie

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_token_counts": tokencount.op2_token_counts,
    "op3_media": media.op3_media,
    "op4_language": language.op4_language,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_neighbours": neighbours.op7_neighbours,
    "op8_lm": lm.op8_lm,
    "op9_mixing": mixing.op9_mixing,
    "op10_packing": packing.op10_packing,
    "op11_negatives": negatives.op11_negatives,
    "op12_quality": quality.op12_quality,
    "op13_trie": trie.op13_trie,
}

ORACLES = {
    "op6_line_dedup": lines.SQL,
    "op9_mixing": mixing.SQL,
    "op11_negatives": negatives.SQL,
    "op13_trie": trie.SQL,
}
