"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .collocations import collocations_sql, op12_collocations
from .filter_audit import filter_audit_sql, op13_filter_audit
from .fingerprints import op4_fingerprints
from .html_extraction import op6_html_extraction
from .language_id import op11_language_id
from .line_dedup import op8_line_dedup
from .lm_scoring import op5_lm_scoring
from .mixing import mixing_sql, op2_mixing
from .near_dedup import op9_near_dedup
from .pii import op10_pii
from .quality_classifier import op3_quality_classifier
from .quality_rules import op7_quality_rules
from .sentencepiece_codec import op1_sentencepiece

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_mixing": op2_mixing,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_fingerprints": op4_fingerprints,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_html_extraction": op6_html_extraction,
    "op7_quality_rules": op7_quality_rules,
    "op8_line_dedup": op8_line_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_pii": op10_pii,
    "op11_language_id": op11_language_id,
    "op12_collocations": op12_collocations,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": mixing_sql(),
}
