"""Time codes and midpoints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_seconds(seconds: Column) -> Column:
    """Seconds as HH:MM:SS,mmm, every part truncated; hours may pass 99."""
    whole = F.floor(seconds)
    ms = F.floor((seconds - whole) * 1000)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60, ms)


def format_ms(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS,mmm; a negative span gets a leading minus."""
    a = F.abs(ms)
    text = F.format_string("%02d:%02d:%02d,%03d", F.floor(a / 3600000), F.floor(a % 3600000 / 60000), F.floor(a % 60000 / 1000), a % 1000)
    return F.concat(F.when(ms < 0, "-").otherwise(""), text)


def parse_ms(code: Column) -> Column:
    """HH:MM:SS,mmm to milliseconds."""
    part = F.split(code, "[:,]")
    at = lambda i: part[i].cast("bigint")
    return ((at(0) * 60 + at(1)) * 60 + at(2)) * 1000 + at(3)


def midpoint_ms(start: Column, end: Column) -> Column:
    """Whole-millisecond midpoint, rounded down."""
    return F.floor((start + end) / 2).cast("bigint")


def screenshot_second(start: Column, end: Column) -> Column:
    """Midpoint floored to a whole second, at which the frame is taken."""
    return F.floor((start + end) / 2000).cast("bigint")


def shift_ms(ms: Column, seconds: int) -> Column:
    """Shifted, but never before 0."""
    return F.greatest(F.lit(0).cast("bigint"), ms + seconds * 1000)
