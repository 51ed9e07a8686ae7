"""Registered queries of the training-data operators: one per operator."""
from __future__ import annotations

from .conversation import op11_conversation_repair
from .decontam import op6_benchmark_decontamination
from .extract import op7_html_extraction
from .langid import op1_language_id
from .lm import op12_lm_scores
from .neardup import op8_near_duplicates
from .packing import op5_best_fit_packing
from .pii import op4_pii_surrogates
from .quality import op9_quality_divergence
from .secrets import op2_secret_scan
from .spelling import op13_spelling_variants
from .tokencount import op10_token_counts
from .warc import op3_warc_salvage

QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_secret_scan, op3_warc_salvage, op4_pii_surrogates, op5_best_fit_packing,
    op6_benchmark_decontamination, op7_html_extraction, op8_near_duplicates, op9_quality_divergence, op10_token_counts,
    op11_conversation_repair, op12_lm_scores, op13_spelling_variants)}
#: DuckDB SQL where an operator can be expressed in it.
ORACLE_SQL: dict[str, str] = {}
