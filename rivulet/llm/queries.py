"""The queries of this package and their SQL."""

from __future__ import annotations

from rivulet.llm import (
    exact_dedup, jaccard_join, language, mixing, packing, prefix_trie, quality, simhash, spotsigs, substring_dedup, toxicity, vector_codes, warc,
)

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_spotsigs": spotsigs.op2_spotsigs,
    "op3_packing": packing.op3_packing,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_quality": quality.op5_quality,
    "op6_simhash": simhash.op6_simhash,
    "op7_language": language.op7_language,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_warc": warc.op9_warc,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_jaccard_join": jaccard_join.op11_jaccard_join,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

# Where SQL can state the result.
ORACLES = {
    "op4_exact_dedup": exact_dedup.SQL,
    "op9_warc": warc.SQL,
    "op10_substring_dedup": substring_dedup.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
