"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tilewright.llm import (
    byte_bpe,
    cap_filters,
    chat_format,
    decontamination,
    hard_negatives,
    language,
    license_scan,
    onebit_ann,
    packing,
    prefix_trie,
    quality,
    simhash,
    token_files,
)

QUERIES = {
    "op1_onebit_ann": onebit_ann.query,
    "op2_license_scan": license_scan.query,
    "op3_byte_bpe": byte_bpe.query,
    "op4_cap_filters": cap_filters.query,
    "op5_token_files": token_files.query,
    "op6_chat_format": chat_format.query,
    "op7_simhash": simhash.query,
    "op8_quality": quality.query,
    "op9_best_fit_packing": packing.query,
    "op10_language": language.query,
    "op11_decontamination": decontamination.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_hard_negatives": hard_negatives.query,
}
SQL = {
    "op4_cap_filters": cap_filters.SQL,
    "op6_chat_format": chat_format.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
