"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .context_tree import op4_context_tree
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .language_id import op9_language_id
from .license_scan import op8_license_scan
from .mixing import op3_mixing
from .piece_codec import op1_piece_codec
from .resampling import op13_resampling
from .secret_ledger import op12_secret_ledger
from .simhash import op2_simhash
from .sort_means import OP11_SQL, op11_sort_means
from .suffix_dedup import op5_suffix_dedup
from .syncmers import op6_syncmers
from .token_counts import op7_token_counts

QUERIES = {f.__name__: f for f in (op1_piece_codec, op2_simhash, op3_mixing, op4_context_tree, op5_suffix_dedup, op6_syncmers, op7_token_counts, op8_license_scan, op9_language_id, op10_exact_dedup, op11_sort_means, op12_secret_ledger, op13_resampling)}
SQL = {"op10_exact_dedup": OP10_SQL, "op11_sort_means": OP11_SQL}
