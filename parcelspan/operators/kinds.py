"""Kinds of message fields: what a JSON value must be for its column.

A kind judges a variant and reads it. The JSON type is looked at before any cast, because casts of a
variant are lenient (true becomes 1.0, "134" and 134.5 become 134, 'yesterday' becomes a time).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Given:
    """A JSON value under judgement: the variant, its JSON type, and the value as text and as a number."""

    variant: Column
    json_type: Column
    text: Column
    number: Column


@dataclass(frozen=True)
class Kind:
    """`json` is the JSON type a value needs ('string', 'number' or 'boolean'), `expected` its name in
    an error, `problem` what else can be wrong with it (NULL when it fits), `read` the typed value."""

    name: str
    sql_type: str
    json: str
    expected: str
    problem: Callable[[Given], Column] | None
    read: Callable[[Column], Column]


REAL_MAX = 3.4028234663852886e38  # fixed value: greatest finite 32-bit float
SMALLINT_MAX = 32767
# ISO 8601 date and time, extended or compact, and the offset a moment needs.
ISO_TIME = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.]\d{1,9})?)?|\d{8}[T ]\d{6}([.]\d{1,9})?)"
OFFSET = r"([Zz]|[+-]\d{2}(:?\d{2})?)"
UUID_FORM = r"^(urn:uuid:)?\{?[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}\}?$"


def described(json_type: Column) -> Column:
    """A JSON type in words."""
    return (
        F.when(json_type == "STRING", "a string")
        .when(json_type == "BOOLEAN", "a boolean")
        .when(json_type == "VOID", "null")
        .when(json_type.startswith("ARRAY"), "an array")
        .when(json_type.startswith("OBJECT"), "an object")
        .otherwise("a number")
    )


def is_number(json_type: Column) -> Column:
    return (
        (json_type == "BIGINT") | (json_type == "DOUBLE") | json_type.startswith("DECIMAL")
        | json_type.isin("INT", "SMALLINT", "TINYINT", "FLOAT")
    )


def fits(json: Column, json_type: Column) -> Column:
    """Whether a JSON type is the one a kind needs."""
    return (
        F.when(json == "string", json_type == "STRING")
        .when(json == "number", is_number(json_type))
        .otherwise(json_type == "BOOLEAN")
    )


def _reader(sql_type: str) -> Callable[[Column], Column]:
    return lambda v: F.try_variant_get(v, "$", sql_type)


def _nul(g: Given) -> Column:
    return F.when(F.instr(g.text, "\u0000") > 0, F.lit("holds a NUL character"))


def _real_problem(g: Given) -> Column:
    return F.when(F.abs(g.number) > REAL_MAX, F.concat(g.text, F.lit(" is beyond a 32-bit float")))


def _smallint_problem(g: Given) -> Column:
    return F.when(
        g.number != F.floor(g.number), F.concat(F.lit("an integer expected, found "), g.text)
    ).when(~g.number.between(-SMALLINT_MAX - 1, SMALLINT_MAX), F.concat(g.text, F.lit(" is beyond a smallint")))


def _uuid_problem(g: Given) -> Column:
    return F.when(~F.lower(g.text).rlike(UUID_FORM), F.lit("a UUID expected"))


def _read_uuid(v: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.try_variant_get(v, "$", "string")), "^urn:uuid:|[{}-]", "")
    return F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def moment(text: Column) -> Column:
    """The moment an ISO 8601 text names. The cast reads the extended form with seconds; other forms are
    brought to it first."""
    spread = F.regexp_replace(F.upper(text), r"^(\d{4})(\d{2})(\d{2})[T ](\d{2})(\d{2})(\d{2})", "$1-$2-$3T$4:$5:$6")
    spread = F.regexp_replace(spread, r"^(.{10}[T ]\d{2}:\d{2})(Z|[+-])", "$1:00$2")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(spread))


def _moment_problem(g: Given) -> Column:
    otherwise = F.when(g.text.rlike(f"^{ISO_TIME}$"), F.lit("a time without a zone offset")).otherwise(
        F.lit("an ISO 8601 time expected")
    )
    return F.when(~g.text.rlike(f"^{ISO_TIME}{OFFSET}$"), otherwise).when(
        moment(g.text).isNull(), F.lit("an ISO 8601 time expected")
    )


def numeric(precision: int, scale: int) -> Kind:
    """Rounded to the scale; refused when it does not fit."""
    sql_type, name = f"decimal({precision},{scale})", f"numeric({precision},{scale})"

    def problem(g: Given) -> Column:
        fits = F.try_variant_get(g.variant, "$", sql_type).isNotNull()
        return F.when(~fits, F.concat(g.text, F.lit(f" does not fit {name}")))

    return Kind(name, sql_type, "number", "a number", problem, _reader(sql_type))


TEXT = Kind("text", "string", "string", "a string", _nul, _reader("string"))
DOUBLE = Kind("double", "double", "number", "a number", None, _reader("double"))
REAL = Kind("real", "float", "number", "a number", _real_problem, _reader("float"))
SMALLINT = Kind("smallint", "smallint", "number", "an integer", _smallint_problem, _reader("smallint"))
BOOLEAN = Kind("boolean", "boolean", "boolean", "true or false", None, _reader("boolean"))
UUID = Kind("uuid", "string", "string", "a string", _uuid_problem, _read_uuid)
TIMESTAMPTZ = Kind(
    "timestamptz", "timestamp", "string", "a string", _moment_problem,
    lambda v: moment(F.try_variant_get(v, "$", "string")),
)
