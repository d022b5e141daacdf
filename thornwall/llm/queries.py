"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op4_bpe
from .fingerprint import op2_fingerprints
from .language import op10_language_id
from .lines import op9_line_dedup
from .packing import op8_best_fit_packing
from .quality import op1_quality_rules
from .simhash import op7_simhash
from .token_counts import op6_token_counts
from .token_files import op3_token_files
from .warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_fingerprints": op2_fingerprints,
    "op3_token_files": op3_token_files,
    "op4_bpe": op4_bpe,
    "op7_simhash": op7_simhash,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
    "op5_warc": op5_warc,
    "op6_token_counts": op6_token_counts,
}

ORACLE_SQL: dict[str, str] = {"op5_warc": OP5_SQL}
