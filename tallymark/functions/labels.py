"""Fields of an answer and their values as label texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A decision: its name, its type and its classes as label texts."""

    name: str
    kind: str
    classes: tuple[str, ...]


FIELDS = (
    Field("urgency", "string", ('"now"', '"soon"', '"later"')),
    Field("category", "string", ('"personal"', '"appointment"', '"billing"', '"notification"', '"newsletter"', '"other"')),
    Field("reply_needed", "boolean", ("true", "false")),
    Field("phishing", "boolean", ("true", "false")),
)
ANSWER = f"struct<{','.join(f'{f.name}:{f.kind}' for f in FIELDS)}>"


def label(value: Column, field: Field) -> Column:
    """A value as JSON text, so that one column can hold all fields and ``true`` differs from ``"true"``."""
    return F.concat(F.lit('"'), value, F.lit('"')) if field.kind == "string" else value.cast("string")


def unlabel(text: Column, field: Field) -> Column:
    return F.regexp_replace(text, '^"|"$', "") if field.kind == "string" else text.cast("boolean")


def long_form(struct: str, fields: tuple[Field, ...] = FIELDS, value: str = "label") -> Column:
    """Explodes an answer into a row for each field: ``field`` and its label, null where it is open."""
    return F.explode(F.array(*(F.struct(F.lit(f.name).alias("field"), label(F.col(f"{struct}.{f.name}"), f).alias(value)) for f in fields)))


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, rounded; null for nothing."""
    return F.round(F.try_divide(part, whole), digits)
