"""Identifiers: unsigned 64-bit values, handles, connection-id bytes and their hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNSIGNED = "decimal(20,0)"


def to_bits(value: Column) -> Column:
    """An unsigned value (decimal) as the ``bigint`` with the same 64 bits."""
    wide = value.cast(UNSIGNED)
    half = F.lit("9223372036854775808").cast(UNSIGNED)
    whole = F.lit("18446744073709551616").cast(UNSIGNED)
    return F.when(wide >= half, wide - whole).otherwise(wide).cast("bigint")


def unsigned(bits: Column) -> Column:
    """The unsigned value of a ``bigint`` bit pattern, ordered as an address."""
    wide = bits.cast(UNSIGNED)
    whole = F.lit("18446744073709551616").cast(UNSIGNED)
    return F.when(wide < 0, wide + whole).otherwise(wide).cast(UNSIGNED)


def parse_id(text: Column) -> Column:
    """Handle text: ``0x`` hex, else decimal, else bare hex, else 0; as 64 bits."""
    clean = F.trim(F.regexp_replace(F.trim(text), '^"+|"+$', ""))
    hexed = F.regexp_replace(F.lower(clean), "^0x", "")
    from_hex = F.conv(hexed, 16, 10).cast(UNSIGNED)
    return to_bits(
        F.when(F.lower(clean).rlike("^0x[0-9a-f]+$"), from_hex)
        .when(clean.rlike("^[+-]?[0-9]+$"), clean.try_cast(UNSIGNED))
        .when(clean.rlike("^[0-9A-Fa-f]+$"), from_hex)
        .otherwise(F.lit(0).cast(UNSIGNED))
    )


def cid_bytes(cid: Column) -> Column:
    """Connection-id text as bytes; text that is not hex stands for its UTF-8 bytes."""
    clean = F.regexp_replace(F.trim(cid), "[\"': -]", "")
    clean = F.regexp_replace(clean, "^0[xX]", "")
    is_hex = clean.rlike("^([0-9A-Fa-f]{2})+$")
    return F.when(is_hex, F.unhex(F.when(is_hex, clean))).otherwise(F.encode(cid, "UTF-8"))


def fnv1a_32(data: Column) -> Column:
    """32-bit FNV-1a over binary data, as a non-negative bigint."""
    text = F.hex(data)
    octets = F.transform(
        F.sequence(F.lit(0), F.greatest(F.length(text) / 2 - 1, F.lit(0)).cast("int")),
        lambda i: F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"),
    )
    hashed = F.aggregate(
        octets,
        F.lit(2166136261).cast("bigint"),
        lambda acc, x: (acc.bitwiseXOR(x) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)),
    )
    return F.when(F.length(text) == 0, F.lit(2166136261).cast("bigint")).otherwise(hashed)
