"""Cleaning expressions: raw text column in, typed column out.

Every function is a ``Column -> Column`` expression of built-ins, so it runs inside
whole-stage codegen over whole tables.

``strict`` decides what happens to text that passes the format check but has no value of
the target type (``1.2.3``, more decimals than are stored, a count beyond 32 bits, a date that
is no date): strict raises
and stops the job, tolerant gives NULL and leaves the counting to the reject report.
The strict error is raised explicitly, so it does not depend on the session's ANSI setting.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "decimal(20,10)"

# The spellings the source files use.
NOT_AVAILABLE = "Not Available"
SENTINELS = ["Not Available", "Not Applicable", "--", ""]
STARS = ["1", "2", "3", "4", "5"]
ID_WIDTH = 6

# \z and not $, which in Java also matches before a final newline.
LOOKS_NUMERIC = r"^-?[0-9.]+\z"
# More decimals than the stored type has, not all of them zero.
LOSES_DIGITS = r"\.[0-9]{10}[0-9]*[1-9]"
LOOKS_COUNT = r"^[0-9]+\z"


def zero_padded(c: Column, width: int) -> Column:
    """At least ``width`` characters; longer text stays whole."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def pad_id(c: Column) -> Column:
    return zero_padded(c, ID_WIDTH)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def unavailable_to_null(c: Column) -> Column:
    return blank_to_null(F.nullif(c, F.lit(NOT_AVAILABLE)))


def _convert(text: Column, applies: Column, converted: Column, what: str, strict: bool) -> Column:
    if strict:
        message = F.concat(F.lit(f"not a valid {what}: "), text)
        converted = F.coalesce(converted, F.raise_error(message))
    return F.when(applies, converted)


def to_number(c: Column, strict: bool = True) -> Column:
    """Exact: a number with more decimals than are stored is not rounded but refused."""
    exact = F.when(~c.rlike(LOSES_DIGITS), c.try_cast(NUMBER))
    return _convert(c, c.rlike(LOOKS_NUMERIC), exact, "number", strict)


def _without_commas(c: Column) -> Column:
    return F.translate(c, ",", "")


def to_count(c: Column, strict: bool = True) -> Column:
    digits = _without_commas(c)
    return _convert(c, digits.rlike(LOOKS_COUNT), digits.try_cast("int"), "count", strict)


def to_stars(c: Column) -> Column:
    return F.when(c.isin(STARS), c.cast("smallint"))


def yes_no(c: Column) -> Column:
    return F.when(c == "Yes", F.lit(True)).when(c == "No", F.lit(False))


def flag_y(c: Column) -> Column:
    return F.coalesce(c == "Y", F.lit(False))


def _parsed_date(c: Column) -> Column:
    return F.coalesce(F.try_to_date(c, "M/d/yyyy"), F.try_to_date(c, "yyyy-MM-dd"))


def to_date(c: Column, strict: bool = True) -> Column:
    return _convert(c, blank_to_null(c).isNotNull(), _parsed_date(c), "date", strict)


# --- what the conversions above would drop, for the reject report -----------------------


def _is_text(c: Column) -> Column:
    return c.isNotNull() & ~c.isin(SENTINELS)


def number_rejected(c: Column) -> Column:
    return _is_text(c) & to_number(c, strict=False).isNull()


def count_rejected(c: Column) -> Column:
    return _is_text(c) & to_count(c, strict=False).isNull()


def stars_rejected(c: Column) -> Column:
    return _is_text(c) & ~c.isin(STARS)


def date_rejected(c: Column) -> Column:
    return blank_to_null(c).isNotNull() & _parsed_date(c).isNull()


def id_rejected(c: Column) -> Column:
    return c.isNotNull() & (F.length(c) > ID_WIDTH)
