"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from .bpe import op4_bpe
from .fingerprints import op7_fingerprints
from .html import OP1_SQL, op1_html
from .jaccard import OP3_SQL, op3_jaccard
from .mixing import OP2_SQL, op2_mixing
from .quality import OP8_SQL, op8_quality
from .scoring import op9_scoring
from .secrets import OP10_SQL, op10_secrets
from .sharding import OP5_SQL, op5_sharding
from .substrings import OP6_SQL, op6_substrings

QUERIES = {"op1_html": op1_html, "op2_mixing": op2_mixing, "op3_jaccard": op3_jaccard, "op4_bpe": op4_bpe, "op5_sharding": op5_sharding, "op6_substrings": op6_substrings, "op7_fingerprints": op7_fingerprints, "op8_quality": op8_quality, "op9_scoring": op9_scoring, "op10_secrets": op10_secrets}
ORACLE = {"op1_html": OP1_SQL, "op2_mixing": OP2_SQL, "op3_jaccard": OP3_SQL, "op5_sharding": OP5_SQL, "op6_substrings": OP6_SQL, "op8_quality": OP8_SQL, "op10_secrets": OP10_SQL}
