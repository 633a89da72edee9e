"""The queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from folio.llm import byte_bpe, exact_dedup, language_id, media, merkle, near_dup, online_packing, packing, pii, quality, spelling, token_counts, url_filter

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_quality": quality.op2_quality,
    "op3_media": media.op3_media,
    "op4_packing": packing.op4_packing,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_language_id": language_id.op8_language_id,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_near_dup": near_dup.op10_near_dup,
    "op11_spelling": spelling.op11_spelling,
    "op12_merkle": merkle.op12_merkle,
    "op13_online_packing": online_packing.op13_online_packing,
}

ORACLES = {
    "op5_url_filter": url_filter.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op10_near_dup": near_dup.ORACLE,
    "op11_spelling": spelling.ORACLE,
    "op12_merkle": merkle.ORACLE,
}
