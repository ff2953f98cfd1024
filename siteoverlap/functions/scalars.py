"""Small column functions for reading and reporting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """Integer from text with blanks and thousands commas; null if it is none."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("bigint")


def pvalue_text(p: Column, replicates: int) -> Column:
    """As many decimals as the replicates resolve; zero becomes 1 / (replicates + 1)."""
    digits = max(0, len(str(replicates)) - 1)
    return F.format_string(f"%.{digits}f", F.when(p <= 0, F.lit(1.0 / (replicates + 1))).otherwise(p))


def probability_text(p: Column) -> Column:
    """Fixed notation above 1e-6, scientific below."""
    return F.when(p > 1e-6, F.format_string("%.6f", p)).otherwise(F.format_string("%.6e", p))


def distance_label(distance: Column) -> Column:
    """10000 -> 1E4."""
    return F.upper(F.regexp_replace(F.format_string("%.0e", distance.cast("double")), r"[+]?0*([0-9]+)$", "$1"))


def stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
