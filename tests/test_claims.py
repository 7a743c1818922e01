"""Claims of operators are backed by the operator that the query calls."""

import inspect

from veriloom.operators import reports, retrieval
from veriloom.plans import catalog
from veriloom.plans.registry import ENTRIES

#: Operator of the survey, the query that claims it, and what the query must call.
BACKED = (
    ("JOI2", "registered_search", "_driver"), ("JOI6", "range_owners", "within"), ("JOI8", "external_scores", "scored_pairs"), ("JOI18", "verified_top1", "second_stage"), ("AGG10", "content_thresholds", "query_thresholds"),
    ("CAL6", "pooled_null", "quantiles"), ("INF10", "verification_bootstrap", "fixed_threshold_bootstrap"), ("LOC17", "gallery", "picks"), ("LOC10", "diagonal_offset", "localize.diagonal_offset"), ("STB3", "plane_hashes", "plane_digests"),
    ("SNK7", "merged_values", "merge_values"), ("RNK3", "prize_winners", "winners"), ("SEC2", "collision_target_rank", "count_above"), ("SRC8", "stored_round_trip", "round_trip"), ("ATK1", "query_expansion", "IMAGE_LADDER"),
)


def test_claims_call_their_operator():
    claimed = catalog.operators()
    for op, name, call in BACKED:
        assert name in claimed[op] and call in inspect.getsource(ENTRIES[name].run), (op, name)


def test_what_has_no_operator_is_not_claimed():
    assert not {"ATK14", "FPR13", "FPR14", "FPR15"} & set(catalog.operators())
    assert callable(reports.round_trip) and callable(retrieval.count_above)
