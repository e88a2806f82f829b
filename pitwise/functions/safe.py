"""Guarded readings of loose values: anything that is not plainly of the wanted
form is null, never an error and never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as a number in a text.
_NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def json_text(doc: Column, path: str) -> Column:
    """The text at a JSON path."""
    return F.get_json_object(doc, path)


def number_or_null(text: Column) -> Column:
    """A double if the text is a plain decimal number (``+5``, ``.5`` and ``5.`` are);
    ``inf``, ``12d`` and padded digits, which a bare cast takes, are null."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def json_number(doc: Column, path: str) -> Column:
    return number_or_null(json_text(doc, path))


def json_boolean(doc: Column, path: str) -> Column:
    """True or false only for JSON booleans, not for the strings that spell them."""
    value = F.try_variant_get(F.try_parse_json(doc), path, "variant")
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(F.try_parse_json(doc), path, "boolean"))


def digits_or_null(text: Column, kind: str = "long") -> Column:
    return F.when(text.rlike("^[0-9]+$"), text.try_cast(kind))


def iso_date_or_null(text: Column) -> Column:
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))


def null_if_any(value: Column, *sentinels: str) -> Column:
    """Null for any of the sentinels."""
    return F.when(~value.isin(*sentinels), value)


def priority_key(*named: tuple[str, Column]) -> Column:
    """The first id that is there, with its kind before it: ``kind:id``."""
    return F.coalesce(*[F.concat(F.lit(f"{kind}:"), value.cast("string")) for kind, value in named])


def clean_identifier(text: Column, *sentinels: str) -> Column:
    """Trimmed, without a trailing ``.0``; sentinels (in any case) and nothing are null."""
    trimmed = F.trim(text)
    known = F.when(~F.lower(trimmed).isin("", *sentinels), trimmed)
    return F.regexp_replace(known, r"\.0$", "")


def finite_or_null(value: Column) -> Column:
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def quality_score(*flags: Column) -> Column:
    """Flags as a binary number, the first the highest bit; null counts as false."""
    total = F.lit(0)
    for f in flags:
        total = total * 2 + F.coalesce(f, F.lit(False)).cast("int")
    return total


def first_present(columns: list[str], *names: str) -> str | None:
    """The first of ``names`` that a table has."""
    return next((n for n in names if n in columns), None)


def date_or_null(year: Column, month: Column, day: Column) -> Column:
    """A date of its parts, null if there is no such day."""
    return F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")
