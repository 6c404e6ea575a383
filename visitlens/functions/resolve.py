"""Finding columns by name, on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame


def containing(columns: list[str], patterns: list[str]) -> str | None:
    """The first column whose lower-cased name contains the first pattern that any column contains."""
    return next((c for p in patterns for c in columns if p in c.lower()), None)


def exactly(columns: list[str], candidates: list[str]) -> str | None:
    """The column that equals the first candidate found, letter case and outer spaces set aside."""
    by_name = {c.strip().lower(): c for c in columns}
    return next((by_name[x] for x in candidates if x in by_name), None)


def standardised(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """df with the columns found for each wanted name renamed to it."""
    found = {exactly(df.columns, candidates): name for name, candidates in wanted.items()}
    return df.withColumnsRenamed({old: new for old, new in found.items() if old})
