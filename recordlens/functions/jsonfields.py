"""Tolerant reads of JSON objects whose field names and types vary by feed.

JSON is cut into its members and elements as they are written: a number keeps its
text, a nested value its own, a repeated name all its values, and a body may be of
any size.  The cutting is done by Python's JSON scanner over Arrow batches.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from json.decoder import WHITESPACE, scanstring

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

FIELDS = T.ArrayType(T.StructType([T.StructField(name, T.StringType()) for name in ("name", "text", "type")]))
RESULTS = T.StructType([
    T.StructField("is_json", T.BooleanType()), T.StructField("found", T.BooleanType()),
    T.StructField("elements", T.ArrayType(T.StructType([T.StructField("raw", T.StringType()), T.StructField("fields", FIELDS)]))),
])
OUTCOME = T.StructType([T.StructField("is_json", T.BooleanType()), T.StructField("found", T.BooleanType()), T.StructField("count", T.IntegerType())])
# Halves of surrogate pairs.
_HALF = re.compile("[\ud800-\udfff]")
# Characters of elements that a Python worker hands over at once.
CHARS_AT_ONCE = 1 << 20


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


@functools.cache
def _scanner() -> json.JSONDecoder:
    """Finds where a value ends; only strings are kept."""
    return json.JSONDecoder(parse_constant=_no_constant, parse_float=str, parse_int=str, object_pairs_hook=lambda pairs: None)


def _gap(text: str, at: int) -> int:
    return WHITESPACE.match(text, at).end()


def _kind(first: str) -> str:
    return {'"': "STRING", "{": "OBJECT", "[": "ARRAY", "t": "BOOLEAN", "f": "BOOLEAN", "n": "VOID"}.get(first, "NUMBER")


def _clean(text: str) -> str:
    """Half of a surrogate pair is no character; it reads as the replacement character."""
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") if not text.isascii() and _HALF.search(text) else text


def members(text: str | None) -> list[tuple[str, str, str]] | None:
    """``(name, text, type)`` of each member of an object in order; None for anything else."""
    return _cut(text, "{", "}")


def elements(text: str | None) -> list[str] | None:
    """The texts of an array's elements as written; None for anything else."""
    found = _cut(text, "[", "]")
    return None if found is None else [raw for _, raw, _ in found]


def _cut(text: str | None, opening: str, closing: str) -> list[tuple[str, str, str]] | None:
    if not text:
        return None
    try:
        at = _gap(text, 0)
        if text[at] != opening:
            return None
        out, at = [], _gap(text, at + 1)
        while text[at] != closing:
            if out:
                if text[at] != ",":
                    return None
                at = _gap(text, at + 1)
            name = ""
            if opening == "{":
                if text[at] != '"':
                    return None
                name, at = scanstring(text, at + 1, True)
                at = _gap(text, at)
                if text[at] != ":":
                    return None
                at = _gap(text, at + 1)
            value, end = _scanner().raw_decode(text, at)
            kind = _kind(text[at])
            shown = value if kind == "STRING" and opening == "{" else text[at:end]
            out.append((_clean(name), _clean(shown), kind))
            at = _gap(text, end)
        return out if _gap(text, at + 1) == len(text) else None
    except (ValueError, IndexError, RecursionError):
        return None


def _is_json(text: str | None) -> bool:
    try:
        value = (text or "").strip(" \t\r\n")
        return _scanner().raw_decode(value, 0)[1] == len(value)
    except (ValueError, IndexError, RecursionError):
        return False


def _read(body: str | None) -> tuple[bool, list[str] | None]:
    """Whether a response is JSON, and the elements of its ``results``; None without such an array."""
    fields = members(body)
    first = next((f for f in fields or [] if f[0].lower() == "results"), None)
    return fields is not None or _is_json(body), elements(first[1]) if first and first[2] == "ARRAY" else None


def _results(body: str | None) -> dict:
    is_json, rows = _read(body)
    return {"is_json": is_json, "found": rows is not None,
            "elements": [{"raw": raw, "fields": members(raw)} for raw in rows or []]}


@pandas_udf(FIELDS)
def object_fields(text: pd.Series) -> pd.Series:
    """``array<struct<name, text, type>>`` of an object; null for anything else."""
    return text.map(members)


@pandas_udf(T.ArrayType(T.StringType()))
def array_elements(text: pd.Series) -> pd.Series:
    """The elements of an array as written; null for anything else."""
    return text.map(elements)


@pandas_udf(RESULTS)
def read_results(body: pd.Series) -> pd.DataFrame:
    """A response read once: whether it is JSON, whether it has a ``results`` array, and each element's text and fields."""
    return pd.DataFrame([_results(b) for b in body], columns=["is_json", "found", "elements"])


@arrow_udf(OUTCOME)
def read_outcome(body: pa.Array) -> pa.Array:
    """What ``read_results`` says of a response, with the number of its elements in place of them; one body at a time is text."""
    found = []
    for b in body:
        is_json, rows = _read(b.as_py())
        found.append({"is_json": is_json, "found": rows is not None, "count": len(rows or [])})
    return pa.array(found, pa.struct([("is_json", pa.bool_()), ("found", pa.bool_()), ("count", pa.int32())]))


def result_elements(envelopes: DataFrame, body: str = "body") -> DataFrame:
    """One row per element of each response's ``results``: the other columns, ``pos``, ``raw`` and ``fields``.

    Elements leave the worker as they are cut, about ``CHARS_AT_ONCE`` characters at a time, so
    its memory follows that and the largest response, not how many responses a batch holds.
    """
    kept = [c for c in envelopes.columns if c != body]
    schema = T.StructType([*(envelopes.schema[c] for c in kept), T.StructField("pos", T.IntegerType()),
                           T.StructField("raw", T.StringType()), T.StructField("fields", FIELDS)])
    fields = pa.list_(pa.struct([(name, pa.string()) for name in FIELDS.elementType.names]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pos, raws, size = [], [], [], 0

            def out() -> pa.RecordBatch:
                rows = pa.array(at, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(rows) for k in range(len(kept))), pa.array(pos, pa.int32()), pa.array(raws, pa.string()),
                     pa.array([members(raw) for raw in raws], fields)], [*kept, "pos", "raw", "fields"])

            for k in range(batch.num_rows):
                for n, raw in enumerate(_read(batch.column(len(kept))[k].as_py())[1] or []):
                    at.append(k)
                    pos.append(n)
                    raws.append(raw)
                    size += len(raw)
                    if size >= CHARS_AT_ONCE:
                        yield out()
                        at, pos, raws, size = [], [], [], 0
            if at:
                yield out()

    return envelopes.select(*kept, body).mapInArrow(cut, schema)


def find_field(fields: Column, name: str) -> Column:
    """The first field of that name in any case, as a struct, or null."""
    return F.get(F.filter(fields, lambda f: F.lower(f["name"]) == name.lower()), F.lit(0))


def read_text(fields: Column, name: str) -> Column:
    """Strings and numbers as written, booleans as True/False, else the empty text."""
    field = find_field(fields, name)
    return F.coalesce(
        F.when(field["type"].isin("STRING", "NUMBER"), field["text"]).when(
            field["type"] == "BOOLEAN", F.initcap(field["text"])
        ),
        F.lit(""),
    )
