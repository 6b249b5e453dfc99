"""Registry of the corpus queries: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from . import bpe, decontamination, gif, html, jaccard, late, licenses, lines, quality, substrings, toxicity, urls, vectors

QUERIES = {
    "op1_toxicity": (toxicity.op1_toxicity, None),
    "op2_byte_bpe": (bpe.op2_byte_bpe, None),
    "op5_quality": (quality.op5_quality, None),
    "op6_url_filter": (urls.op6_url_filter, None),
    "op9_html": (html.op9_html, None),
    "op8_ngram_jaccard": (jaccard.op8_ngram_jaccard, jaccard.OP8_SQL),
    "op4_line_dedup": (lines.op4_line_dedup, lines.OP4_SQL),
    "op10_licenses": (licenses.op10_licenses, licenses.OP10_SQL),
    "op7_gif": (gif.op7_gif, None),
    "op11_substring_dedup": (substrings.op11_substring_dedup, substrings.OP11_SQL),
    "op12_late_overwrite": (late.op12_late_overwrite, None),
    "op13_vector_codes": (vectors.op13_vector_codes, vectors.OP13_SQL),
    "op3_decontamination": (decontamination.op3_decontamination, decontamination.OP3_SQL),
}
