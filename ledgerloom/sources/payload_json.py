"""Payloads as raw JSON text: read once into a Variant, fields taken by path and type, and what is broken kept apart."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read_payloads(raw: DataFrame, text: str, fields: dict[str, tuple[str, str]], required: Iterable[str] = ()) -> DataFrame:
    """raw with a column for each field, name: (JSON path, type), and `reject`: null, or the first thing wrong.

    NO_TEXT: null or blank. NOT_JSON: no JSON, or JSON that is cut off. NOT_AN_OBJECT: a list or a bare value.
    MISSING <field>: a required field is absent, null or an empty text. TYPE <field>: a field is there but is not of
    its type, and is no text that could be. Fields of a rejected payload are null. Numbers may be numbers or text, as venues
    send both; an empty text counts as absent.
    """
    required = set(required)
    if unknown := required - set(fields):
        raise ValueError(f"required fields without a path: {sorted(unknown)}")
    held = raw.withColumn("__v", F.try_parse_json(F.col(text)))
    at = lambda path, kind: F.try_variant_get("__v", path, kind)
    # A nested object or list has no text, so its JSON stands for it; JSON's null is none.
    nested = lambda path: F.when(~F.is_variant_null(at(path, "variant")), F.to_json(at(path, "variant")))
    # Each field is read once, into columns of its own that the checks and the result share.
    held = held.withColumns({f"__t_{name}": at(path, "string") for name, (path, _) in fields.items()} | {f"__x_{name}": at(path, kind) for name, (path, kind) in fields.items() if kind != "string"})
    held = held.withColumns({f"__s_{name}": F.nullif(F.trim(F.coalesce(F.col(f"__t_{name}"), nested(path))), F.lit("")).isNotNull() for name, (path, _) in fields.items()})
    stated = {name: F.col(f"__s_{name}") for name in fields}
    values = {name: F.col(f"__t_{name}" if kind == "string" else f"__x_{name}") for name, (_, kind) in fields.items()}
    faults: list[tuple[Column, Column]] = [
        (F.col(text).isNull() | (F.trim(F.col(text)) == ""), F.lit("NO_TEXT")),
        (F.col("__v").isNull(), F.lit("NOT_JSON")),
        (~F.ltrim(F.col(text), F.lit(" \t\r\n")).startswith("{"), F.lit("NOT_AN_OBJECT")),
        *[(~stated[name], F.lit(f"MISSING {name}")) for name in fields if name in required],
        *[(stated[name] & values[name].isNull(), F.lit(f"TYPE {name}")) for name in fields],
    ]
    held = held.withColumn("reject", reduce(lambda rest, fault: F.when(*fault).otherwise(rest), reversed(faults), F.lit(None).cast("string")))
    return held.withColumns({name: F.when(F.col("reject").isNull() & stated[name], value) for name, value in values.items()}).drop("__v", *[f"__{x}_{name}" for x in "tsx" for name in fields])


def accepted(read: DataFrame, text: str) -> DataFrame:
    return read.filter("reject is null").drop("reject", text)


def rejects(read: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """The payloads that were not taken, as they came, with what is wrong with each."""
    return read.filter("reject is not null").select(*keys, text, "reject")
