"""Typed values: numbers, literals, coordinates, points.

Parsers return a second column beside the raw text: null where the text does not parse, so the raw text is never lost.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .uris import NAMESPACES

XSD = NAMESPACES["xsd"]
_TRIM = r"^[\s]+|[\s]+$"
#: What a decimal and an integer look like, after trimming.
DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"
FLOATS, DECIMALS, INTEGERS, STRINGS = ("float", "double"), ("decimal",), ("int", "integer"), ("string",)


def stripped(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, _TRIM, "")


def parse_decimal(c: Column) -> Column:
    """The number as a double, else null."""
    text = stripped(c)
    return F.when(text.rlike(DECIMAL), text.try_cast("double"))


def parse_integer(c: Column) -> Column:
    """The number as a long, else null (also for 1.7 and for numbers that do not fit)."""
    text = stripped(c)
    return F.when(text.rlike(INTEGER), text.try_cast("long"))


def parse_number(c: Column) -> Column:
    """struct(whole long, real double): digits alone give whole, other numbers real; both null for the rest."""
    digits = c.rlike("^[0-9]+$")
    return F.struct(F.when(digits, c.try_cast("long")).alias("whole"), F.when(~digits, parse_decimal(c)).alias("real"))


def drop_digit_groups(c: Column) -> Column:
    """A cell of digits and commas alone, without the commas; other cells unchanged."""
    return F.when(c.rlike(r"^[0-9,]+\n?\z"), F.replace(c, F.lit(","), F.lit(""))).otherwise(c)


def typed_literal(value: Column, datatype: Column) -> Column:
    """struct(text, real, whole) of a literal by its datatype (absolute URI or null); unknown datatypes raise."""
    local = F.replace(datatype, F.lit(XSD), F.lit(""))
    as_text = datatype.isNull() | local.isin(*STRINGS)
    as_real, as_whole = local.isin(*FLOATS, *DECIMALS), local.isin(*INTEGERS)
    bad = F.raise_error(F.concat(F.lit("unknown datatype "), datatype)).cast("string")
    return F.struct(
        F.when(as_text, value).when(as_real | as_whole, F.lit(None).cast("string")).otherwise(bad).alias("text"),
        F.when(as_real, parse_decimal(value)).alias("real"),
        F.when(as_whole, parse_integer(value)).alias("whole"),
    )


def valid_literal(value: Column, datatype: Column) -> Column:
    """Whether a literal's text is valid for its datatype; strings always are, null datatypes count as strings."""
    local = F.coalesce(F.replace(datatype, F.lit(XSD), F.lit("")), F.lit("string"))
    return (
        F.when(local.isin(*STRINGS), F.lit(True))
        .when(local.isin(*FLOATS, *DECIMALS), parse_decimal(value).isNotNull())
        .when(local.isin(*INTEGERS), parse_integer(value).isNotNull())
        .otherwise(F.raise_error(F.concat(F.lit("unknown datatype "), datatype)).cast("boolean"))
    )


def point(longitude: Column, latitude: Column) -> Column:
    """``POINT(long lat)`` with five decimals; null if either is null."""
    return F.when(longitude.isNotNull() & latitude.isNotNull(), F.format_string("POINT(%.5f %.5f)", longitude, latitude))


def point_of_texts(longitude: Column, latitude: Column) -> Column:
    """``POINT (long lat)`` of two non-blank texts as they are."""
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return F.when(filled(longitude) & filled(latitude), F.concat(F.lit("POINT ("), longitude, F.lit(" "), latitude, F.lit(")")))


def _degrees(part: Column) -> Column:
    """Degrees of one coordinate: decimal, or degrees, minutes and seconds; S and W are negative."""
    numbers = F.regexp_extract_all(part, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    at = lambda i: F.coalesce(F.try_element_at(numbers, F.lit(i)).cast("double"), F.lit(0.0))
    size = at(1) + at(2) / 60 + at(3) / 3600
    sign = F.when(part.rlike("[SW-]"), -1).otherwise(1)
    return F.when((F.size(numbers) > 0) & (size == 0), F.lit(0.0)).when((F.size(numbers) >= 1) & (F.size(numbers) <= 3), sign * size)


def parse_coordinate(c: Column) -> Column:
    """``POINT(long lat)`` of a text with a latitude and a longitude in either order; null where it cannot be read.

    The text is upper-cased, with letters that scans confuse put right (b for N, đ for E, t for W), and parted after the first letter of
    a direction. If the second part holds E or W the first is the latitude, else they are swapped.
    """
    text = F.upper(F.translate(F.lower(stripped(c)), "bđt", "new"))
    rx = r"""^([0-9\s.°′″'"]+[A-Z])(.*)$"""
    first, second = F.regexp_extract(text, rx, 1), F.regexp_extract(text, rx, 2)
    ordered = second.rlike("[EW]")
    lat, long = F.when(ordered, _degrees(first)).otherwise(_degrees(second)), F.when(ordered, _degrees(second)).otherwise(_degrees(first))
    sound = text.rlike(rx) & lat.between(-90, 90) & long.between(-180, 180)
    return F.when(sound, point(long, lat))
