"""Arithmetic on times and windows: Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: Column, high: Column) -> Column:
    """Into [low, high]; low where they cross."""
    return F.greatest(low, F.least(x, high))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def frames(start_ms: Column, end_ms: Column, fps: int) -> tuple[Column, Column]:
    """First frame and number of frames, one at least."""
    return half_up(start_ms * fps / 1000), F.greatest(F.lit(1), half_up((end_ms - start_ms) * fps / 1000))


def bell(t: Column, length: Column) -> Column:
    """Half a sine over the length, nothing outside."""
    return F.when((t >= 0) & (t <= length), F.sin(F.lit(3.141592653589793) * t / length)).otherwise(0.0)


def ramp(t: Column, length: Column, up: float = 0.25) -> Column:
    """Rises over the first part, falls over the rest."""
    share = t / length
    return F.when((share < 0) | (share > 1), 0.0).when(share < up, share / up).otherwise((1 - share) / (1 - up))


def fade(t: Column, length: Column, edge: Column) -> Column:
    """0 to 1 over an edge at the start and back at the end."""
    return clamp(F.least(t / edge, (length - t) / edge), F.lit(0.0), F.lit(1.0))
