"""Scalar column functions: instants, numbers, local days, z-scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Europe/Budapest"
#: Population norms (mean, standard deviation) of cycle and luteal lengths in days, and the flag's width.
NORMS = {"cycle_length": (29.30, 3.89), "luteal_length": (13.27, 2.67)}
FLAG_SIGMA = 2.0


def instant(text) -> Column:
    """`yyyy-MM-dd HH:mm:ss Z` text, or anything else that reads as a timestamp, as an instant; null if neither."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss Z")), F.try_to_timestamp(c))


def number(text) -> Column:
    """Decimal or exponent notation as double, else null; type suffixes and hexadecimal forms are text."""
    c = F.trim(F.col(text) if isinstance(text, str) else text)
    plain = c.rlike(r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$|^[+-]?(?i:nan|inf|infinity)$")
    return F.when(plain, F.regexp_replace(c, "_", "").try_cast("double"))


def local_day(ts, zone: str = LOCAL_ZONE, naive: bool = False) -> Column:
    """Calendar day in ``zone`` of an instant, or of a UTC wall-clock value with ``naive``."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), c)) if naive else F.to_date(F.from_utc_timestamp(c, zone))


def z_score(x, norm: str) -> Column:
    """(x - mean) / sd of a population norm, unrounded."""
    mean, sd = NORMS[norm]
    return (F.col(x) if isinstance(x, str) else x).cast("double").__sub__(F.lit(mean)) / F.lit(sd)


def out_of_norm(z: Column) -> Column:
    return F.abs(z) > FLAG_SIGMA


def drift(actual: Column, expected: Column, tolerance: float = 0.02) -> Column:
    """OK within ``tolerance`` of the expected count, else DRIFT; an expected 0 must be met exactly."""
    close = F.when(expected == 0, actual == 0).otherwise(F.abs(actual - expected) <= tolerance * F.abs(expected))
    return F.when(close, F.lit("OK")).otherwise(F.lit("DRIFT"))


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Price of model tokens; prices are for a million."""
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def seconds(duration: Column, unit: Column) -> Column:
    """Minutes become seconds, everything else stays."""
    return F.when(F.lower(unit) == "min", duration * 60).otherwise(duration)
