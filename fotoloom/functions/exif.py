"""Values in EXIF text: dates, exposure, GPS, colour temperature."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?)"


def exif_date(s: Column) -> Column:
    """Time of an EXIF date in any of the forms that cameras write; null if none fits."""
    text = F.trim(F.replace(F.trim(s), F.lit('"'), F.lit("")))
    text = F.regexp_replace(text, "T", " ")
    text = F.regexp_replace(text, r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3")
    text = F.regexp_replace(text, r"(\.\d{6})\d+$", "$1")
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]")))


def creation_date(original: Column, created: Column, file_created: Column) -> Column:
    return F.coalesce(exif_date(original), exif_date(created), file_created)


def first_number(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, _NUMBER, 1), F.lit("")).cast("double")


def fraction(s: Column) -> Column:
    """``1/250 s`` and ``2.5`` to a number; null for anything else and for a zero divisor."""
    text = F.trim(F.regexp_replace(s, "(?i)s", ""))
    lead = lambda c: F.nullif(F.regexp_extract(c, r"^\s*(-?[0-9]*\.?[0-9]+)", 1), F.lit("")).cast("double")
    parts = F.split(text, "/")
    ratio = F.try_divide(lead(parts.getItem(0)), lead(F.try_element_at(parts, F.lit(2))))
    return F.when(F.size(parts) == 2, ratio).otherwise(lead(text))


def shutter(s: Column) -> Column:
    """Seconds; 0 if missing or bad, as sorting and search expect."""
    return F.coalesce(fraction(s), F.lit(0.0))


def aperture(s: Column) -> Column:
    return F.coalesce(first_number(F.regexp_replace(s, "^[fF]/?", "")), F.lit(0.0))


def focal(s: Column) -> Column:
    return F.coalesce(first_number(s), F.lit(0.0))


def iso(main: Column, other: Column) -> Column:
    return F.coalesce(first_number(main), first_number(other), F.lit(0.0))


def exposure_seconds(exposure: Column, speed: Column) -> Column:
    """As shutter, but null if missing: merges need to know."""
    return F.coalesce(fraction(exposure), fraction(speed))


def iso_value(speed: Column, sensitivity: Column, ratings: Column) -> Column:
    clean = lambda c: F.trim(c).try_cast("int")
    return F.coalesce(clean(speed), clean(sensitivity), clean(ratings))


def gps_decimal(text: Column, ref: Column) -> Column:
    """``48 deg 8 min 12.5 sec`` with N, S, E or W to signed degrees; null if a part is missing."""
    part = lambda unit: F.nullif(F.regexp_extract(text, _NUMBER + r"\s*" + unit, 1), F.lit("")).cast("double")
    value = part("deg") + part("min") / 60 + part("sec") / 3600
    return F.when(F.upper(F.trim(ref)).isin("S", "W"), -value).when(F.upper(F.trim(ref)).isin("N", "E"), value)


# EXIF LightSource codes and their colour temperature.
LIGHT_SOURCES = {1: 5500, 2: 4000, 3: 2850, 4: 6000, 9: 5500, 10: 6500, 11: 7500, 12: 5000, 13: 5000, 14: 5000, 15: 5000, 17: 2850, 18: 4870, 19: 6770, 20: 5500, 21: 6500, 22: 7500, 23: 5000, 24: 2850}
MIN_KELVIN, MAX_KELVIN = 2000.0, 50000.0
DEFAULT_KELVIN = 5500
MIRED_SHIFT = 150.0


def as_shot_kelvin(keys: list[Column], light_source: Column) -> Column:
    """The first key in 2000..50000, else by light source, else 5500."""
    sane = [F.when(first_number(k).between(2000, 50000), first_number(k)) for k in keys]
    table = F.create_map(*[F.lit(x) for k, v in LIGHT_SOURCES.items() for x in (k, float(v))])
    return F.coalesce(*sane, F.try_element_at(table, first_number(light_source).cast("int")), F.lit(float(DEFAULT_KELVIN)))


def _within(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def kelvin_to_relative(kelvin: Column, as_shot: Column) -> Column:
    """Slider value -100..100 by mired distance."""
    shift = 1e6 / _within(as_shot, MIN_KELVIN, MAX_KELVIN) - 1e6 / _within(kelvin, MIN_KELVIN, MAX_KELVIN)
    return _within(shift / MIRED_SHIFT * 100, -100.0, 100.0)


def relative_to_kelvin(value: Column, as_shot: Column) -> Column:
    mired = 1e6 / _within(as_shot, MIN_KELVIN, MAX_KELVIN) - value / 100 * MIRED_SHIFT
    return F.when(mired <= 0, MAX_KELVIN).otherwise(_within(F.try_divide(F.lit(1e6), mired), MIN_KELVIN, MAX_KELVIN))


def tint_to_relative(tint: Column) -> Column:
    return _within(tint / 1.5, -100.0, 100.0)


def relative_to_tint(value: Column) -> Column:
    return value * 1.5


def megapixels(width: Column, height: Column) -> Column:
    return F.round(width.cast("double") * height / 1e6, 1)
