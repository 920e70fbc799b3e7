"""Queries of the corpus operators, with SQL where DuckDB can express them on whole tables."""

from __future__ import annotations

from . import licenses, near_dedup, substring_dedup, suffix_dedup
from .fingerprints import op1_fingerprints
from .licenses import op7_licenses
from .mixing import op3_mixing
from .multi_index import op4_multi_index
from .near_dedup import op6_near_dedup
from .pieces import op2_pieces
from .pii import op8_pii
from .quality import op9_quality
from .substring_dedup import op5_substring_dedup
from .suffix_dedup import op10_suffix_dedup

QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_pieces, op3_mixing, op4_multi_index, op5_substring_dedup, op6_near_dedup, op7_licenses, op8_pii, op9_quality, op10_suffix_dedup)}
ORACLE_SQL: dict[str, str] = {"op5_substring_dedup": substring_dedup.oracle(), "op6_near_dedup": near_dedup.oracle(), "op7_licenses": licenses.oracle(), "op10_suffix_dedup": suffix_dedup.oracle()}
