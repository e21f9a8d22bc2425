"""Message contracts: how the JSON value of a topic becomes a typed row or a dead letter.

`classify` checks every message in a fixed order; the first stage that fails gives the reason, and a
stage names all of its failing fields. Values are not judged here: a latitude of 0 is a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspan.operators.kinds import (
    BOOLEAN, DOUBLE, REAL, SMALLINT, TEXT, TIMESTAMPTZ, UUID, Given, Kind, described, fits, is_number, numeric,
)

ENVELOPE = "topic string, partition int, offset bigint, key binary, value binary, timestamp timestamp"
SUPPORTED_VERSIONS = (1,)
MAX_ERROR_CHARS = 1_000

# The reasons of a dead letter.
UNKNOWN_TOPIC = "unknown_topic"
EMPTY_MESSAGE = "empty_message"
INVALID_JSON = "invalid_json"
NOT_AN_OBJECT = "not_an_object"
MISSING_FIELD = "missing_field"
UNSUPPORTED_SCHEMA_VERSION = "unsupported_schema_version"
INVALID_FIELD = "invalid_field"
UNKNOWN_SOURCE = "unknown_source"
REJECTED_BY_DATABASE = "rejected_by_database"


@dataclass(frozen=True)
class Contract:
    """A topic's table: its columns with their kinds, the fields that must be there, the natural key,
    and the column that keeps every other field as JSON."""

    topic: str
    table: str
    fields: tuple[tuple[str, Kind], ...]
    required: tuple[str, ...]
    key: tuple[str, ...]
    residual: str
    residual_default: str | None = None

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(name for name, _ in self.fields)

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.names, self.residual)


METADATA = (("source", TEXT), ("event_time", TIMESTAMPTZ), ("schema_version", SMALLINT))
METADATA_NAMES = tuple(name for name, _ in METADATA)

# The fields, required fields and keys of the three topics.
GPS_PINGS = Contract(
    topic="gps.pings",
    table="gps_pings",
    fields=(
        ("vehicle_id", TEXT), ("route_id", TEXT), ("lat", DOUBLE), ("lon", DOUBLE), ("speed_kmh", REAL),
        ("heading_deg", SMALLINT), ("accuracy_m", REAL), *METADATA,
    ),
    required=("vehicle_id", *METADATA_NAMES),
    key=("vehicle_id", "event_time"),
    residual="extra_fields",
)
VEHICLE_TELEMETRY = Contract(
    topic="vehicle.telemetry",
    table="vehicle_telemetry",
    fields=(
        ("vehicle_id", TEXT), ("route_id", TEXT), ("speed_kmh", REAL), ("odometer_km", numeric(9, 1)),
        ("ignition_on", BOOLEAN), ("energy_level_pct", REAL), ("energy_used_total", numeric(10, 3)),
        ("energy_unit", TEXT), ("cargo_door_open", BOOLEAN), *METADATA,
    ),
    required=("vehicle_id", *METADATA_NAMES),
    key=("vehicle_id", "event_time"),
    residual="readings",
    residual_default="{}",
)
DELIVERY_EVENTS = Contract(
    topic="delivery.events",
    table="delivery_events",
    fields=(
        ("event_id", UUID), ("order_id", TEXT), ("route_id", TEXT), ("stop_sequence", SMALLINT), ("vehicle_id", TEXT),
        ("driver_id", TEXT), ("status", TEXT), ("failure_reason", TEXT), ("lat", DOUBLE), ("lon", DOUBLE),
        ("pod_object_key", TEXT), *METADATA,
    ),
    required=("event_id", "order_id", *METADATA_NAMES),
    key=("event_id",),
    residual="extra_fields",
)
CONTRACTS = (GPS_PINGS, VEHICLE_TELEMETRY, DELIVERY_EVENTS)


def parsed(envelopes: DataFrame) -> DataFrame:
    """Add `_data`, the value as a variant, NULL when it is not strict JSON in UTF-8.

    The parser stops after the first JSON value and ignores what follows. Wrapped once as an array
    element and once as an object member, a value with anything after it cannot be valid in both.
    """
    text = F.when(F.is_valid_utf8(F.col("value").cast("string")), F.col("value").cast("string"))
    wrapped = envelopes.select(
        "*",
        F.try_parse_json(F.concat(F.lit('{"m":'), text, F.lit("}"))).alias("_member"),
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull().alias("_alone"),
    )
    data = F.when(F.col("_member").isNotNull() & F.col("_alone"), F.try_variant_get("_member", "$.m", "variant"))
    return wrapped.select(*envelopes.columns, data.alias("_data"))


def _distinct_kinds(contracts: Sequence[Contract]) -> dict[str, Kind]:
    return {kind.name: kind for c in contracts for _, kind in c.fields}


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _per_topic(contracts: Sequence[Contract], entry: Callable[[Contract], str]) -> Column:
    """The entry of the message's topic, from a constant map. `entry` gives the entry as a SQL literal,
    which takes one step to build where a Column for every text would take hundreds."""
    pairs = ", ".join(f"{_text(c.topic)}, {entry(c)}" for c in contracts)
    return F.expr(f"try_element_at(map({pairs}), topic)")


def _problem_of(field: Column, kinds: dict[str, Kind]) -> Column:
    """What is wrong with the value of a field, NULL when nothing is. The checks of all kinds are
    written once and serve the fields of every contract."""
    name, kind = field["name"], field["kind"]
    variant, json_type = F.try_element_at("_members", name), F.try_element_at("_types", name)
    given = Given(
        variant, json_type, F.try_variant_get(variant, "$", "string"), F.try_variant_get(variant, "$", "double")
    )
    problem = F.when(json_type.isNull() | (json_type == "VOID"), F.lit(None).cast("string")).when(
        ~fits(field["json"], json_type), F.concat(field["expected"], F.lit(" expected, found "), described(json_type))
    )
    for k in kinds.values():
        if k.problem is not None:
            problem = problem.when(kind == k.name, k.problem(given))
    return F.concat(name, F.lit(": "), problem)


def _field(name: str, kind: Kind) -> str:
    parts = {"name": name, "kind": kind.name, "json": kind.json, "expected": kind.expected}
    return "named_struct(" + ", ".join(f"'{k}', {_text(v)}" for k, v in parts.items()) + ")"


@dataclass(frozen=True)
class Compiled:
    """The Columns of a set of contracts."""

    missing: Column
    wrong: Column
    verdict: Column
    rows: tuple[Column, ...]


@lru_cache(maxsize=16)
def _compiled(contracts: tuple[Contract, ...], application: str) -> Compiled:
    """Built once per application: every micro-batch uses the same Columns."""
    del application  # Columns belong to the JVM of their application
    kinds = _distinct_kinds(contracts)
    fields = _per_topic(contracts, lambda c: "array(" + ", ".join(_field(n, k) for n, k in c.fields) + ")")
    required = _per_topic(contracts, lambda c: "array(" + ", ".join(map(_text, c.required)) + ")")
    version = F.try_variant_get("_data", "$.schema_version", "variant")
    known = F.coalesce(
        is_number(F.col("_version_type"))
        & F.try_variant_get("_data", "$.schema_version", "double").isin(*map(float, SUPPORTED_VERSIONS)),
        F.lit(False),
    )
    fed = F.coalesce(F.col("topic").isin(*[c.topic for c in contracts]), F.lit(False))
    stages = [
        (~fed, UNKNOWN_TOPIC, F.concat(F.lit("no table is fed by topic "), F.col("topic"))),
        (F.col("value").isNull() | (F.octet_length("value") == 0), EMPTY_MESSAGE, F.lit("the message has no value")),
        (F.col("_data").isNull(), INVALID_JSON, F.lit("not JSON")),
        (
            ~F.col("_type").startswith("OBJECT"),
            NOT_AN_OBJECT,
            F.concat(F.lit("an object expected, found "), described(F.col("_type"))),
        ),
        (F.col("_missing") != "", MISSING_FIELD, F.concat(F.lit("missing "), F.col("_missing"))),
        (
            ~known,
            UNSUPPORTED_SCHEMA_VERSION,
            F.concat(F.lit("schema_version "), F.to_json(version), F.lit(f" is not among {list(SUPPORTED_VERSIONS)}")),
        ),
        (F.col("_wrong") != "", INVALID_FIELD, F.col("_wrong")),
    ]
    verdict: Column | None = None
    for fails, reason, error in stages:
        found = F.struct(F.lit(reason).alias("reason"), error.alias("error"))
        verdict = F.when(fails, found) if verdict is None else verdict.when(fails, found)
    return Compiled(
        missing=F.array_join(F.filter(required, _absent), ", ").alias("_missing"),
        wrong=F.array_join(F.array_compact(F.transform(fields, lambda f: _problem_of(f, kinds))), "; ").alias("_wrong"),
        verdict=verdict.alias("_verdict"),
        rows=tuple(
            F.when(F.col("_verdict").isNull() & (F.col("topic") == c.topic), _row(c)).alias(c.table) for c in contracts
        ),
    )


def classify(
    envelopes: DataFrame, sources: DataFrame | None, contracts: Sequence[Contract] = CONTRACTS
) -> DataFrame:
    """The envelopes with `reason` and `error` (NULL for a row) and, per contract, a struct column named
    after its table that holds the typed row.

    `sources` is the registry (source_id); None skips that check. Nothing is shuffled unless the
    registry is too large to travel to the tasks.
    """
    columns = _compiled(tuple(contracts), envelopes.sparkSession.sparkContext.applicationId)
    opened = parsed(envelopes).select(
        "*",
        F.schema_of_variant("_data").alias("_type"),
        F.try_variant_get("_data", "$", "map<string,variant>").alias("_members"),
    ).select("*", F.transform_values("_members", lambda _, v: F.schema_of_variant(v)).alias("_types"))
    staged = opened.select(
        *envelopes.columns, "_data", "_members", "_type", columns.missing, columns.wrong,
        F.try_element_at("_types", F.lit("schema_version")).alias("_version_type"),
    )
    judged = staged.select("*", columns.verdict).select(
        *envelopes.columns, F.col("_verdict.reason").alias("reason"), F.col("_verdict.error").alias("error"), *columns.rows
    )
    return judged if sources is None else check_sources(judged, sources, contracts)


def _absent(name: Column) -> Column:
    """Whether a required field is not there, null or empty text."""
    json_type = F.try_element_at("_types", name)
    empty = (json_type == "STRING") & (F.try_variant_get(F.try_element_at("_members", name), "$", "string") == "")
    return json_type.isNull() | (json_type == "VOID") | empty


def _row(contract: Contract) -> Column:
    """The typed row of a message that passed, the fields without a column kept as JSON."""
    values = [kind.read(F.try_element_at("_members", F.lit(name))).cast(kind.sql_type).alias(name) for name, kind in contract.fields]
    rest = F.map_filter("_members", lambda k, _: ~k.isin(*contract.names))
    default = F.lit(contract.residual_default).cast("string")
    residual = F.when(F.size(rest) > 0, F.to_json(rest)).otherwise(default)
    return F.struct(*values, residual.alias(contract.residual))


def check_sources(
    judged: DataFrame, sources: DataFrame, contracts: Sequence[Contract] = CONTRACTS
) -> DataFrame:
    """Turn rows whose source is not registered into dead letters.

    The registry is a short table: Spark sends it to the rows by its size. The join also keeps filters
    on the verdict from being copied into the parsing below it.
    """
    source = F.coalesce(*[F.col(c.table)["source"] for c in contracts])
    marked = judged.withColumn("_source", F.when(F.col("reason").isNull(), source))
    registry = sources.select(F.col("source_id").alias("_source")).distinct().withColumn("_known", F.lit(True))
    looked = marked.join(registry, "_source", "left")
    unknown = F.col("reason").isNull() & ~F.coalesce("_known", F.lit(False))
    return looked.select(
        *[c for c in judged.columns if c not in ("reason", "error", *[k.table for k in contracts])],
        F.when(unknown, UNKNOWN_SOURCE).otherwise(F.col("reason")).alias("reason"),
        F.when(unknown, F.concat(F.lit("source "), F.col("_source"), F.lit(" is not registered")))
        .otherwise(F.col("error"))
        .alias("error"),
        *[F.when(~unknown, F.col(c.table)).alias(c.table) for c in contracts],
    )


def refuse_unstorable(judged: DataFrame, contracts: Sequence[Contract] = CONTRACTS) -> DataFrame:
    """Rows the target table would refuse, a NUL inside the residual JSON, become dead letters of their
    own, so that no row blocks its batch."""
    residual = F.coalesce(*[F.col(c.table)[c.residual] for c in contracts])
    nul = residual.rlike(r"(?<!\\)(?:\\\\)*\\u0000")  # the escape itself, not an escaped backslash before it
    refused = F.coalesce(F.col("reason").isNull() & nul, F.lit(False))
    return judged.select(
        *[c for c in judged.columns if c not in ("reason", "error", *[k.table for k in contracts])],
        F.when(refused, REJECTED_BY_DATABASE).otherwise(F.col("reason")).alias("reason"),
        F.when(refused, F.lit("the table refuses a NUL character in a JSON field")).otherwise(F.col("error")).alias("error"),
        *[F.when(~refused, F.col(c.table)).alias(c.table) for c in contracts],
    )


def rows_of(judged: DataFrame, contract: Contract) -> DataFrame:
    """The typed rows of one table, with the place in the topic that decides which repeat stays."""
    return judged.where(F.col("reason").isNull() & (F.col("topic") == contract.topic)).select(
        f"{contract.table}.*", "partition", "offset"
    )


def clean_error(error: Column) -> Column:
    return F.substring(F.replace(error, F.lit("\u0000"), F.lit("\\x00")), 1, MAX_ERROR_CHARS)


def dead_letters_of(judged: DataFrame) -> DataFrame:
    """The messages that are not rows: bytes kept, keyed by their place in the topic."""
    return judged.where(F.col("reason").isNotNull()).select(
        "topic",
        F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"),
        F.col("timestamp").alias("kafka_timestamp"),
        F.col("key").alias("message_key"),
        F.col("value").alias("payload"),
        "reason",
        clean_error(F.col("error")).alias("error"),
    )


def message_json(df: DataFrame, columns: Sequence[str]) -> Column:
    """The JSON value of a message: one object with the columns in order, NULLs left out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})
