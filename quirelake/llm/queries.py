"""Registered queries of the corpus operators and their SQL, where SQL has them."""

from __future__ import annotations

from .byte_bpe import op7_byte_bpe
from .embedding_dedup import op1_embedding_dedup
from .license_scan import op9_license_scan
from .line_dedup import op8_line_dedup
from .minhash_dedup import op3_minhash_dedup
from .oracles import ORACLE_SQL as ORACLE_SQL
from .packing import op6_packing
from .quality_rules import op4_quality_rules
from .secret_scan import op5_secret_scan
from .token_counts import op2_token_counts
from .token_store import op10_token_store

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_secret_scan": op5_secret_scan,
    "op6_packing": op6_packing,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_line_dedup": op8_line_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_token_store": op10_token_store,
}
