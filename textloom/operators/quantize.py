"""Symmetric integer codes of number arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scale_of(values: Column, bits: int = 6) -> Column:
    """Largest magnitude over the largest code; 1 for all zeros."""
    most = F.array_max(F.transform(values, lambda x: F.abs(x.cast("double"))))
    return F.when(F.coalesce(most, F.lit(0.0)) == 0, 1.0).otherwise(most / float((1 << (bits - 1)) - 1))


def codes_of(values: Column, scale: Column, bits: int = 6) -> Column:
    """floor(x / scale + 1/2), clamped."""
    top = (1 << (bits - 1)) - 1
    return F.transform(values, lambda x: F.greatest(F.lit(-top), F.least(F.lit(top), F.floor(x.cast("double") / scale + 0.5).cast("int"))))


def values_of(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda c: c * scale)


def argmax(values: Column) -> Column:
    """Index of the largest value, the lowest on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
