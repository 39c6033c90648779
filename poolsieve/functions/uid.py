"""128-bit sample ids: 32 hex digits, or 16 bytes that sort as unsigned numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_uid(uid: Column) -> Column:
    return F.coalesce(uid.rlike("^[0-9a-fA-F]{32}$"), F.lit(False))


def uid_bin(uid: Column) -> Column:
    """16 bytes, big end first; null where the text is no id."""
    return F.when(is_uid(uid), F.unhex(F.lower(uid)))


def padded_uid_bin(uid: Column) -> Column:
    """As ``uid_bin`` for tables that drop leading zeros."""
    return uid_bin(F.lpad(uid, 32, "0"))


def uid_hex(uid: Column) -> Column:
    return F.lower(F.hex(uid))


def high(uid_hex: Column) -> Column:
    """The upper 64 bits as a decimal, as a long would lose the sign."""
    return F.conv(F.substring(uid_hex, 1, 16), 16, 10).cast("decimal(20,0)")


def low(uid_hex: Column) -> Column:
    return F.conv(F.substring(uid_hex, 17, 16), 16, 10).cast("decimal(20,0)")


def copy_key(uid: Column, copy: Column) -> Column:
    """The output key of a sample's n-th copy."""
    return F.concat(uid, F.lit("-"), copy.cast("string"))
