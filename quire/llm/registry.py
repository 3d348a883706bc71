"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from quire.llm import (bpe, infill, jaccard, language, mixing, neardup, packing, quality, rules, substring, toxicity, trie,
                       warc)

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_quality": quality.op3_quality,
    "op4_language": language.op4_language,
    "op5_neardup": neardup.op5_neardup,
    "op6_warc": warc.op6_warc,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_packing": packing.op8_packing,
    "op9_substring": substring.op9_substring,
    "op10_rules": rules.op10_rules,
    "op11_infill": infill.op11_infill,
    "op12_mixing": mixing.op12_mixing,
    "op13_trie": trie.op13_trie,
}

SQL: dict[str, str] = {
    "op5_neardup": neardup.OP5_SQL,
    "op6_warc": warc.OP6_SQL,
    "op7_jaccard": jaccard.OP7_SQL,
    "op9_substring": substring.OP9_SQL,
    "op10_rules": rules.OP10_SQL,
    "op11_infill": infill.OP11_SQL,
    "op12_mixing": mixing.OP12_SQL,
    "op13_trie": trie.OP13_SQL,
}
