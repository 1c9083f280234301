"""Digest columns from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Base32 SHA-256 of no bytes: the digest of a record that stored no body.
EMPTY_SHA256 = "4OYMIQUY7QOBJGX36TEJS35ZEQT24QPEMSNZGTFESWMRW6CSXBKQ"


def hex_to_base32(digits: Column, bits: int) -> Column:
    """RFC 4648 base32 without padding of a hexadecimal text of `bits` bits: five hex digits make four characters."""
    need = -(-bits // 5)
    padded = F.rpad(digits, -(-bits // 20) * 5, "0")

    def four(i: Column) -> Column:
        n = F.conv(F.substring(padded, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(ALPHABET), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.substring(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(-(-bits // 20) - 1)), four), ""), 1, need)


def sha256_base32(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), hex_to_base32(F.sha2(data, 256), 256))


def sha1_base32(data: Column) -> Column:
    return F.concat(F.lit("sha1:"), hex_to_base32(F.sha1(data), 160))


def sha256_hex(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def chain_ref(chain: Column) -> Column:
    """First 16 hex digits of the hash over a joined certificate chain."""
    return F.substring(F.sha2(F.array_join(chain, ""), 256), 1, 16)
