"""Plan inspection: the physical plan text a user reads with ``explain``."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """What ``df.explain(mode)`` prints, as a string (for plan assertions)."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def count_nodes(df: DataFrame, node: str, mode: str = "simple") -> int:
    """Occurrences of a physical operator name (e.g. 'Exchange', 'Expand')."""
    return plan_text(df, mode).count(node)
