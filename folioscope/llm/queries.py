"""Registry of the training-data queries and of their SQL where SQL can express them."""

from __future__ import annotations

from .gru import op10_recurrent_scores
from .mixing import op8_pareto_mix
from .outliers import op4_robust_outliers
from .packing import op5_vector_packing
from .pii import op1_information_pii
from .quality import op3_site_quality
from .repeats import op2_repeated_strings
from .simhash import op9_simhash
from .topk import OP7_SQL, op7_cover_tree_topk
from .urls import op6_url_rules

QUERIES = {f.__name__: f for f in (
    op1_information_pii, op2_repeated_strings, op3_site_quality, op4_robust_outliers, op5_vector_packing,
    op6_url_rules, op7_cover_tree_topk, op8_pareto_mix, op9_simhash, op10_recurrent_scores)}

SQL = {"op7_cover_tree_topk": OP7_SQL}
