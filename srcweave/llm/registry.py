"""The queries of this subpackage and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .centroid_clustering import op13_centroid_clustering
from .conversation_repair import op11_conversation_repair
from .decontamination import op8_decontamination
from .fingerprints import op12_fingerprints
from .jaccard_join import op6_jaccard_join
from .license_scan import op10_license_scan
from .line_dedup import op2_line_dedup
from .oracles import ORACLES
from .packing import op5_packing
from .pii import op7_pii
from .quality_classifier import op4_quality_classifier
from .quality_rules import op9_quality_rules
from .sharding import op3_feistel_sharding
from .substring_dedup import op1_substring_dedup

_ALL = (
    op1_substring_dedup,
    op2_line_dedup,
    op3_feistel_sharding,
    op4_quality_classifier,
    op5_packing,
    op6_jaccard_join,
    op7_pii,
    op8_decontamination,
    op9_quality_rules,
    op10_license_scan,
    op11_conversation_repair,
    op12_fingerprints,
    op13_centroid_clustering,
)
QUERIES = {f.__name__: f for f in _ALL}

__all__ = ["ORACLES", "QUERIES"]
