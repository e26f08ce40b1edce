"""Identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the DNS namespace of RFC 4122, hex digits without dashes.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = DNS_NAMESPACE) -> Column:
    """RFC 4122 version-5 UUID of a string column, built from the engine's own SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    # The variant digit keeps the low two bits of hex digit 17 and sets the high two to binary 10.
    variant = F.substring(
        F.lit("89ab89ab89ab89ab"), (F.instr(F.lit("0123456789abcdef"), F.substring(h, 17, 1))), 1
    )
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"),
        F.substring(h, 9, 4), F.lit("-5"),
        F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"),
        F.substring(h, 21, 12),
    )
