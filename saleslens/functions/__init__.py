"""Column expressions, formatting and join helpers shared by the operators."""

from saleslens.functions.expressions import (
    discounted,
    flag01,
    guarded_ship_days,
    in_years,
    pair_key,
    ratio,
    ship_days,
    yes_no,
)
from saleslens.functions.formatting import fmt_number, fmt_percent, format_report
from saleslens.functions.joins import proven_small, sized_broadcast

__all__ = [
    "discounted",
    "flag01",
    "guarded_ship_days",
    "in_years",
    "pair_key",
    "ratio",
    "ship_days",
    "yes_no",
    "fmt_number",
    "fmt_percent",
    "format_report",
    "proven_small",
    "sized_broadcast",
]
