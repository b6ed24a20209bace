"""Predicates on the two clocks of a fact: when it held, and when it was believed.

Every window is half-open and a null bound is no bound. A claim's own validity is closed at both ends.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(at: datetime | str) -> Column:
    """Literal of an instant, without a zone."""
    return F.lit(str(at)).cast("timestamp_ntz")


def covers(start: str, end: str, at: Column) -> Column:
    """Whether [start, end) contains at."""
    return (F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (F.col(end) > at))


def holds(valid_at: Column) -> Column:
    return covers("valid_from", "valid_until", valid_at)


def believed(at: Column) -> Column:
    return covers("ingested_at", "invalidated_at", at)


def current(at: Column) -> Column:
    """Held and believed now: what was ever invalidated is not, whenever that was."""
    return (F.col("ingested_at") <= at) & F.col("invalidated_at").isNull() & holds(at)


def fact_time(mode: str, evaluated_at: Column, at: Column | None = None, start: Column | None = None, end: Column | None = None) -> Column:
    """Condition of a time mode: current, at (one instant), overlap (an interval) or history (all begun by now)."""
    believed_now = F.col("invalidated_at").isNull()
    if mode == "current":
        return current(evaluated_at)
    if mode == "at":
        return believed_now & holds(at)
    if mode == "overlap":
        begins = F.lit(True) if end is None else F.col("valid_from").isNull() | (F.col("valid_from") <= end)
        ends = F.lit(True) if start is None else F.col("valid_until").isNull() | (F.col("valid_until") > start)
        return believed_now & begins & ends
    if mode == "history":
        return F.col("valid_from").isNull() | (F.col("valid_from") <= evaluated_at)
    raise ValueError(f"unknown time mode {mode!r}: current, at, overlap or history")


def claim_touches(start: Column, end: Column) -> Column:
    """Whether a dated claim's closed validity meets [start, end]; claims of unknown precision never do."""
    return (F.col("claim_valid_precision") != "unknown") & (F.col("claim_valid_from") <= end) & (F.col("claim_valid_until").isNull() | (F.col("claim_valid_until") >= start))
