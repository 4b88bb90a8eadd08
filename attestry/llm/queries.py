"""The registered queries of this subpackage: name to (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from . import hamming_search, html_extract, language_id, licenses, minhash_dedup, mixing, quality_rules, sentence_pieces, substring_dedup, token_files, vector_codes, warc, whitening

QUERIES = {
    "op1_warc": warc.op1,
    "op2_quality_rules": quality_rules.op2,
    "op3_sentence_pieces": sentence_pieces.op3,
    "op4_language_id": language_id.op4,
    "op5_hamming_search": hamming_search.op5,
    "op6_mixing": mixing.op6,
    "op7_minhash_dedup": minhash_dedup.op7,
    "op8_html_extract": html_extract.op8,
    "op9_token_files": token_files.op9,
    "op10_substring_dedup": substring_dedup.op10,
    "op11_whitening": whitening.op11,
    "op12_vector_codes": vector_codes.op12,
    "op13_license_scan": licenses.op13,
}
