"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from .html import op10_html_text
from .media import op4_media_columns
from .mixing import OP9_SQL, op9_mix_poisson
from .near_dedup import op8_near_dedup
from .packing import op7_pack_sequences
from .pii import op5_pii_bootstrap
from .quality import OP1_SQL, op1_quality_lines
from .secrets import op3_secret_scan
from .sharding import op6_shard_lpt
from .substring import OP2_SQL, op2_substring_dedup

QUERIES = {
    "op1_quality_lines": op1_quality_lines,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_media_columns": op4_media_columns,
    "op5_pii_bootstrap": op5_pii_bootstrap,
    "op6_shard_lpt": op6_shard_lpt,
    "op7_pack_sequences": op7_pack_sequences,
    "op8_near_dedup": op8_near_dedup,
    "op9_mix_poisson": op9_mix_poisson,
    "op10_html_text": op10_html_text,
}
ORACLE_SQL = {"op1_quality_lines": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op9_mix_poisson": OP9_SQL}
