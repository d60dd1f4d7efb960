"""Hashes that other engines reproduce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_LOW = (1 << 32) - 1


def _word(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _cut(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW))


def _add(a: Column, c: Column) -> Column:
    """Sum modulo 2^64 by halves, since BIGINT sums that overflow are errors."""
    low = _cut(a) + _cut(c)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(c, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(_cut(high), 32).bitwiseOR(_cut(low))


def _times(a: Column, c: int) -> Column:
    """Product modulo 2^64 from 16-bit limbs of the constant."""
    l0, l1, h0, h1 = (c >> s & 0xFFFF for s in (0, 16, 32, 48))
    a0, a1 = _cut(a), F.shiftrightunsigned(a, 32)
    p0, p1 = a0 * l0, a0 * l1
    shifted = lambda x: F.shiftleft(x.bitwiseAND(F.lit(0xFFFF)), 16)
    low = _cut(p0) + shifted(p1)
    carry = F.shiftrightunsigned(p0, 32) + F.shiftrightunsigned(p1, 16) + F.shiftrightunsigned(low, 32)
    high = _cut(a0 * h0) + shifted(a0 * h1) + _cut(a1 * l0) + shifted(a1 * l1)
    return F.shiftleft(_cut(carry + high), 32).bitwiseOR(_cut(low))


def gamma(seed: int) -> int:
    """The increment of a seed as a signed word, to be passed to :func:`with_splitmix64`."""
    return _word((seed + GOLDEN) & ((1 << 64) - 1))


def with_splitmix64(df: DataFrame, x: str, increment: Column | dict[str, Column], to: str | None = None) -> DataFrame:
    """Adds ``to``: splitmix64 of ``x`` as a signed BIGINT with the same bits; or one such column per entry of ``increment``.

    One column per step: nested in one expression the operands would be repeated exponentially often.
    """
    wanted = increment if isinstance(increment, dict) else {to: increment}
    df = df.withColumns({c: _add(F.col(x).cast("long"), i) for c, i in wanted.items()})
    for shift, factor in ((30, MIX_A), (27, MIX_B)):
        df = df.withColumns({c: F.col(c).bitwiseXOR(F.shiftrightunsigned(c, shift)) for c in wanted})
        df = df.withColumns({c: _times(F.col(c), factor) for c in wanted})
    return df.withColumns({c: F.col(c).bitwiseXOR(F.shiftrightunsigned(c, 31)) for c in wanted})


def unsigned_order(x: Column) -> Column:
    """Sorts signed words as unsigned ones."""
    return x.bitwiseXOR(F.lit(_word(1 << 63)))


def stratum_id(columns: dict[str, Column]) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of ``name=value|...``; null counts as ''."""
    parts = [F.concat(F.lit(f"{name}="), F.coalesce(c.cast("string"), F.lit(""))) for name, c in columns.items()]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
