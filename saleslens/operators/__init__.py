"""Table-level operators: profiling, audit, corrections, gates, marts."""

from saleslens.operators.audit import (
    children_per_parent,
    distinct_pairs,
    hierarchy_check,
    identifier_cardinality,
    multi_parent,
    multi_parent_detail,
    name_fanout,
    negative_rows,
    pairs_for,
    signed_ratio_by_period,
    values_reused_across,
)
from saleslens.operators.corrections import (
    apply_by_key,
    apply_field_policy,
    apply_market_correction,
    apply_subcategory_correction,
    market_correction_map,
    subcategory_correction_map,
)
from saleslens.operators.gates import (
    analysis_snapshot,
    category_performance,
    contribution,
    core_totals,
    discount_over_index,
    flag_rate,
    market_performance,
    period_share,
    share_stability,
    ship_mode_performance,
    stability_verdict,
    yoy_growth,
)
from saleslens.operators.marts import date_dimension, reporting_fact
from saleslens.operators.profiling import column_profile, duplicate_rows, numeric_range_stats, sample_rows

__all__ = [n for n in dir() if not n.startswith("_")]
