"""Safe numbers, unit conversion, bit distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_decimal(text: Column, scale: int = 10) -> Column:
    """A decimal, or null for text that isn't a plain number or has more digits than the type holds."""
    clean = F.trim(text)
    whole = F.length(F.regexp_replace(F.regexp_extract(clean, r"^[+-]?(\d*)", 1), "^0+", ""))
    part = F.length(F.regexp_extract(clean, r"\.(\d*)$", 1))
    fits = clean.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$") & (whole <= 38 - scale) & (part <= scale)
    return F.when(fits, clean.try_cast(f"decimal(38,{scale})"))


def canonical_number(text: Column) -> Column:
    """One spelling of equal numbers: no sign of plus, no leading or trailing zeros."""
    t = F.regexp_replace(F.trim(text), r"^\+", "")
    t = F.when(t.contains("."), F.regexp_replace(F.regexp_replace(t, r"0+$", ""), r"\.$", "")).otherwise(t)
    t = F.regexp_replace(t, r"^(-?)0+(?=\d)", "$1")
    return F.when(t.isin("-0", ""), "0").otherwise(t)


def symmetric_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.greatest(a / b, b / a))


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def quantity(value: Column, unit: Column) -> Column:
    """Weights in kilograms and temperatures in degrees Celsius."""
    return F.when(unit == "kg", value).when(unit == "g", value / 1000).when(unit == "lb", value * 0.45359237).when(unit == "C", value).when(unit == "F", (value - 32) * 5 / 9)


def bucket(value: Column, bounds: list[float], labels: list[str]) -> Column:
    """The label of the first bound that the value doesn't pass; the last label beyond all."""
    out = F.lit(labels[-1])
    for b, label in zip(reversed(bounds), reversed(labels[:-1]), strict=True):
        out = F.when(value <= b, label).otherwise(out)
    return F.when(value.isNotNull(), out)
