"""Keys, digests and reproducible draws."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """Name-based UUID (version 5) in canonical lower-case form."""
    digest = F.sha1(F.concat(F.lit(bytearray(namespace.bytes)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def md5_number(text: Column) -> Column:
    """The first 60 bits of the MD5 of a text as a bigint, the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def uniform(*key: Column | str, seed: int) -> Column:
    """A number in [0, 1) fixed by the key and the seed: a draw that never changes between runs or engines."""
    named = [F.col(k) if isinstance(k, str) else k for k in key]
    text = F.concat_ws("|", *[k.cast("string") for k in named], F.lit(str(seed)))
    return md5_number(text) / F.lit(float(1 << 60))


def canonical_row(columns: list[str]) -> Column:
    """A text that is equal for two rows exactly when their values are: columns by name, NULL marked."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in sorted(columns)]
    return F.concat_ws("\u001f", *parts)


def route_name(day: Column, zone_id: Column, wave: Column, number: Column) -> Column:
    """R-<yyyymmdd>-<zone>-<wave initial><number>."""
    return F.concat(
        F.lit("R-"), F.date_format(day, "yyyyMMdd"), F.lit("-"), zone_id, F.lit("-"),
        F.upper(F.substring(wave, 1, 1)), number.cast("string"),
    )


def photo_key(day: Column, order_id: Column) -> Column:
    return F.concat(F.lit("pod/"), F.date_format(day, "yyyy-MM-dd"), F.lit("/"), order_id.cast("string"), F.lit(".jpg"))
