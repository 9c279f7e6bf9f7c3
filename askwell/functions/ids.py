"""Content-derived ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askwell.schemas import KIND_SUFFIX, SUFFIX_KIND


def content_id(text: Column, kind: str | None = None) -> Column:
    """UUID version 5, in the all-zero namespace, of the hex SHA-256 of ``text``.

    Built from JVM hash functions only. With ``kind`` the id gets that kind's suffix, so the kind of
    a stored row can be told from its id.
    """
    digest = F.sha1(F.concat(F.unhex(F.lit("00" * 16)), F.sha2(text, 256).cast("binary")))
    variant = F.conv(F.substring(digest, 17, 2), 16, 10).cast("bigint").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))
    uuid5 = F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.lower(F.hex(variant)), F.substring(digest, 19, 2)),
        F.substring(digest, 21, 12),
    )
    full = uuid5 if kind is None else F.concat(uuid5, F.lit("-" + KIND_SUFFIX[kind]))
    return F.when(text.isNotNull(), full)


def kind_from_id(id_col: Column) -> Column:
    """Kind named by the id's last dash-separated part; null where the suffix is unknown."""
    suffix = F.substring_index(id_col, "-", -1)
    kind = F.lit(None).cast("string")
    for name, value in SUFFIX_KIND.items():
        kind = F.when(suffix == name, value).otherwise(kind)
    return kind
