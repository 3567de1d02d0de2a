"""Keyed hashes: stable choices that don't depend on the order or partitioning of rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def keyed(*parts: Column, salt: str) -> Column:
    """Hex SHA-256 of the parts and the salt, joined by bars."""
    return F.sha2(F.concat_ws("|", *parts, F.lit(salt)), 256)


def hex_mod(digest: Column, n: int | Column) -> Column:
    """A hex number of any length modulo n, folded digit by digit so that nothing overflows."""
    n = F.lit(n) if isinstance(n, int) else n
    digits = F.transform(F.split(digest, ""), lambda d: F.instr(F.lit("0123456789abcdef"), d).cast("bigint") - 1)
    return F.aggregate(F.filter(digits, lambda d: d >= 0), F.lit(0).cast("bigint"), lambda a, d: (a * 16 + d) % n.cast("bigint"))


def hash_digits(digest: Column, form: str) -> Column:
    """``form`` with each # replaced by a decimal digit from the successive pairs of hex digits."""
    out, k = [], 0
    for part in form:
        if part == "#":
            out.append((F.conv(F.substr(digest, F.lit(2 * k + 1), F.lit(2)), 16, 10).cast("int") % 10).cast("string"))
            k += 1
        else:
            out.append(F.lit(part))
    return F.concat(*out)


def sample_order(key: Column, seed: int) -> Column:
    """An order that only depends on the key and the seed."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def digest_mod(digest: Column, n: int | Column, part: int = 0) -> Column:
    """Eight hex digits of a digest, those of number ``part``, modulo n: fits in 64 bits, so no fold over digits is needed."""
    return F.conv(F.substr(digest, F.lit(8 * part + 1), F.lit(8)), 16, 10).cast("bigint") % (F.lit(n) if isinstance(n, int) else n)


def digits_like(digest: Column, like: Column) -> Column:
    """``like`` with each of its digits replaced by one that follows from the digest; the first is never 0, all else stays."""

    def one(c: Column, i: Column) -> Column:
        at = F.pmod(i, F.lit(60)).cast("int") + 1
        d = F.conv(F.substr(digest, at, F.lit(4)), 16, 10).cast("int")
        return F.when(c.rlike("[0-9]"), F.when(i == 0, d % 9 + 1).otherwise(d % 10).cast("string")).otherwise(c)

    return F.array_join(F.transform(F.split(like, ""), one), "")
