"""Returns and exact decimals as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 8


def return_bps(start: Column, end: Column) -> Column:
    """Simple return in basis points; a start that isn't positive is an error."""
    checked = F.when(start > 0, start).when(start.isNotNull(), F.raise_error("a price must be positive").cast("double"))
    return (end - checked) / checked * 10_000


def scaled(x: Column, scale: int = SCALE) -> Column:
    """A decimal as an integer of 10**-scale units, truncated toward zero."""
    d = x.cast("decimal(30,12)")
    return (F.signum(d.cast("double")).cast("int") * F.floor(F.abs(d) * F.lit(10**scale).cast("decimal(10,0)")).cast("decimal(38,0)")).cast("decimal(38,0)")


def mul_scaled(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Product of two scaled integers, truncated."""
    return F.call_function("div", a.cast("decimal(19,0)") * b.cast("decimal(19,0)"), F.lit(10**scale).cast("decimal(10,0)")).cast("decimal(38,0)")


def div_scaled(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Quotient of two scaled integers, truncated."""
    return F.call_function("div", a.cast("decimal(28,0)") * F.lit(10**scale).cast("decimal(10,0)"), b).cast("decimal(38,0)")


def unscaled(a: Column, scale: int = SCALE) -> Column:
    return (a.cast("decimal(28,0)") / F.lit(10**scale).cast("decimal(10,0)")).cast(f"decimal(28,{scale})")
