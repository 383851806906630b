"""Vehicle identity: VIN shape, descriptor, trim key and the fit of a version."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import NOT_LETTER_OR_DIGIT, is_blank, non_blank, trim_ws

VIN_LENGTH = 17
DESCRIPTOR_LENGTH = 8
UNKNOWN_FIT = "trim not decoded"


def is_vin(col: Column) -> Column:
    return F.coalesce(trim_ws(col).rlike("(?i)^[A-HJ-NPR-Z0-9]{%d}$" % VIN_LENGTH), F.lit(False))


def normalise_vin(col: Column) -> Column:
    return F.upper(non_blank(col))


def vin_descriptor(col: Column) -> Column:
    """The first eight characters, or null for a shorter VIN."""
    vin = F.upper(trim_ws(col))
    return F.when(F.length(vin) >= DESCRIPTOR_LENGTH, F.substring(vin, 1, DESCRIPTOR_LENGTH))


def trim_key(col: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(col, NOT_LETTER_OR_DIGIT, "")), F.lit(""))


def fit(trim: Column, litres: Column, cylinders: Column) -> Column:
    """A fit struct; blank trims and numbers that are not positive become unknown."""
    litres = litres.cast("decimal(4,1)")
    return F.struct(
        non_blank(trim).alias("trim"),
        trim_key(trim).alias("trim_key"),
        F.when(litres > 0, litres).alias("engine_litres"),
        F.when(cylinders > 0, cylinders.cast("int")).alias("engine_cylinders"),
    )


def fit_is_known(trim: Column, litres: Column, cylinders: Column) -> Column:
    return trim.isNotNull() | litres.isNotNull() | cylinders.isNotNull()


def fit_label(trim: Column, litres: Column, cylinders: Column) -> Column:
    """``trim · 5.2L · 8 cyl`` with the unknown parts left out."""
    size = F.regexp_replace(litres.cast("decimal(4,1)").cast("string"), r"\.0$", "")
    label = F.concat_ws(
        " · ",
        trim,
        F.concat(size, F.lit("L")),
        F.concat(cylinders.cast("string"), F.lit(" cyl")),
    )
    return F.when(fit_is_known(trim, litres, cylinders), label).otherwise(F.lit(UNKNOWN_FIT))


def fits(record: dict[str, Column], owned: dict[str, Column]) -> Column:
    """Every attribute agrees or is unknown on either side."""
    agreed = F.lit(True)
    for name in ("trim_key", "engine_litres", "engine_cylinders"):
        mine, theirs = record[name], owned[name]
        agreed = agreed & (mine.isNull() | theirs.isNull() | (mine == theirs))
    return agreed


def payload_vin(raw: Column) -> Column:
    """The VIN inside a stored complaint payload; null when absent or not JSON."""
    from .jsonfields import object_fields, read_text

    return F.when(~is_blank(raw), non_blank(read_text(object_fields(raw), "vin")))
