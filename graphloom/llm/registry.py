"""Registered queries of the corpus operators, with their SQL where it can express them."""

from __future__ import annotations

from graphloom.llm import bpe, fingerprints, html_text, language_id, licenses, media, ngram_join, packing, pii, token_rollups


def queries():
    return {
        "op1_pii_spans": pii.op1_pii_spans,
        "op2_vector_best_fit": packing.op2_vector_best_fit,
        "op3_html_text": html_text.op3_html_text,
        "op4_bpe_tokens": bpe.op4_bpe_tokens,
        "op5_interleaved_media": media.op5_interleaved_media,
        "op6_prefix_fingerprints": fingerprints.op6_prefix_fingerprints,
        "op6_shared_spans": fingerprints.op6_shared_spans,
        "op7_license_scan": licenses.op7_license_scan,
        "op8_token_rollups": token_rollups.op8_token_rollups,
        "op9_ngram_jaccard_join": ngram_join.op9_ngram_jaccard_join,
        "op10_language_mixture": language_id.op10_language_mixture,
    }


def oracle_sql():
    return {"op6_prefix_fingerprints": fingerprints.OP6_SQL, "op8_token_rollups": token_rollups.OP8_SQL, "op9_ngram_jaccard_join": ngram_join.OP9_SQL}
