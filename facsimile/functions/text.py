"""String helpers as Catalyst expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns the profile and the detectors test values against.
EMAIL_VALUE_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
SSN_PATTERN = r"^\d{3}-\d{2}-\d{4}$"
CARD_PATTERN = r"^\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}$"
LOOSE_EMAIL_PATTERN = r"^[^@]+@[^@]+\.[^@]+$"
PHONE_PATTERN = r"^[\d\s\-\(\)\+]{10,}$"
DIGIT_PATTERN = r"\d"
SPECIAL_PATTERN = r"[^a-zA-Z0-9\s]"

# Java regex classes are ASCII unless (?U) is given; the source semantics are
# Unicode-aware for \d, \s and \w, so every pattern runs with (?U).
UNICODE = "(?U)"


def rlike_u(col: Column, pattern: str) -> Column:
    return col.rlike(UNICODE + pattern)


def word_count(col: Column) -> Column:
    """Number of whitespace-separated words (empty or blank text has 0)."""
    return F.regexp_count(col, F.lit(UNICODE + r"\S+")).cast("long")


def capitalize(col: Column) -> Column:
    """First character upper, rest lower (Python ``str.capitalize``)."""
    return F.concat(F.upper(F.substring(col, 1, 1)), F.lower(F.substring(col, 2, 1 << 30)))


def ntz_micros(col: Column) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock (NTZ) timestamp,
    independent of the session time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, col.cast("timestamp_ntz"))


def micros_to_ntz(us: Column) -> Column:
    """Inverse of ``ntz_micros``."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", us, epoch)
