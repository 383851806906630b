"""Validation of queries and registrations: the first problem wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.identity import is_vin, normalise_vin
from ..functions.text import is_blank, non_blank, option, trim_ws

# Limits, option names and problem texts.
MIN_QUERY_LENGTH = 2
MAX_QUERY_LENGTH = 500
DEFAULT_LIMIT = 10
MAX_LIMIT = 50
MIN_MODEL_YEAR = 1949
MODES = ["dense", "sparse", "hybrid"]
SCOPES = ["all", "campaigns"]
TRIMS = ["thisTrim", "allTrims"]
QUERY_LENGTH_PROBLEM = "The query must be between 2 and 500 characters."
MODE_PROBLEM = "Unknown mode '%s'. Use dense, sparse, or hybrid."
SCOPE_PROBLEM = "Unknown scope '%s'. Use all or campaigns."
TRIMS_PROBLEM = "Unknown trims '%s'. Use thisTrim or allTrims."
LIMIT_PROBLEM = "The limit must be between 1 and 50."
DATES_PROBLEM = "filedFrom is later than filedTo, so the range holds no dates."
MAKE_PROBLEM = 'A make is required, for example "Ford".'
MODEL_PROBLEM = 'An NHTSA model name is required, for example "EXPLORER".'
NAME_PROBLEM = 'A display name is required, for example "2013 Explorer Sport".'
VIN_PROBLEM = (
    "A VIN is 17 letters and digits, never I, O, Q. "
    "Leave it blank if you do not have it to hand."
)
YEAR_PROBLEM = "The model year must be between %d and %d."


def _split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.where("problem IS NULL").drop("problem"), checked.where("problem IS NOT NULL")


def checked_queries(queries: DataFrame, max_length: int | None = MAX_QUERY_LENGTH) -> DataFrame:
    """Queries with defaults filled in, and a ``problem`` that is null when valid.

    A text may have ``max_length`` characters, or any number with None.
    """
    mode = option(F.col("mode"), MODES, "hybrid")
    scope = option(F.col("scope"), SCOPES, "all")
    trims = option(F.col("trims"), TRIMS, "allTrims")
    length = F.length(F.coalesce(trim_ws(F.col("text")), F.lit("")))
    problem = (
        F.when(~length.between(MIN_QUERY_LENGTH, max_length or 2**31 - 1), F.lit(QUERY_LENGTH_PROBLEM))
        .when(mode.isNull(), F.format_string(MODE_PROBLEM, "mode"))
        .when(scope.isNull(), F.format_string(SCOPE_PROBLEM, "scope"))
        .when(trims.isNull(), F.format_string(TRIMS_PROBLEM, "trims"))
        .when(~F.col("limit").between(1, MAX_LIMIT), F.lit(LIMIT_PROBLEM))
        .when(F.col("filed_from") > F.col("filed_to"), F.lit(DATES_PROBLEM))
    )
    valid = lambda value, given: F.when(problem.isNull(), value).otherwise(given)
    return queries.withColumns({
        "problem": problem,
        "mode": valid(mode, F.col("mode")),
        "scope": valid(scope, F.col("scope")),
        "trims": valid(trims, F.col("trims")),
        "limit": F.coalesce(F.col("limit"), F.lit(DEFAULT_LIMIT)),
        "component": F.upper(non_blank(F.col("component"))),
        "text": valid(trim_ws(F.col("text")), F.col("text")),
    })


def validate_queries(queries: DataFrame, max_length: int | None = MAX_QUERY_LENGTH) -> tuple[DataFrame, DataFrame]:
    """Valid queries in normal form, and rejects with their first problem."""
    return _split(checked_queries(queries, max_length))


def checked_registrations(registrations: DataFrame, year_now: int) -> DataFrame:
    """Registrations with a ``problem`` that is null when valid, texts normalised."""
    latest = year_now + 1
    given_vin: Column = ~is_blank(F.col("vin"))
    problem = (
        F.when(is_blank(F.col("make")), F.lit(MAKE_PROBLEM))
        .when(is_blank(F.col("model")), F.lit(MODEL_PROBLEM))
        .when(is_blank(F.col("display_name")), F.lit(NAME_PROBLEM))
        .when(given_vin & ~is_vin(F.col("vin")), F.lit(VIN_PROBLEM))
        .when(
            F.coalesce(~F.col("model_year").between(MIN_MODEL_YEAR, latest), F.lit(True)),
            F.lit(YEAR_PROBLEM % (MIN_MODEL_YEAR, latest)),
        )
    )
    return registrations.withColumns({
        "problem": problem,
        "make": F.upper(trim_ws(F.col("make"))),
        "model": F.upper(trim_ws(F.col("model"))),
        "recall_model": F.upper(non_blank(F.col("recall_model"))),
        "display_name": trim_ws(F.col("display_name")),
        "vin": normalise_vin(F.col("vin")),
    })


def validate_registrations(
    registrations: DataFrame, year_now: int
) -> tuple[DataFrame, DataFrame]:
    return _split(checked_registrations(registrations, year_now))
