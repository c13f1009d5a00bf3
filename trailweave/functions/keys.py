"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone (session zone UTC)."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def java_hash(text: Column) -> Column:
    """The signed 32-bit string hash of the JVM, over UTF-16 code units."""
    digits = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(
        F.filter(F.sequence(F.lit(0), F.length(digits)), lambda i: (i % 4 == 0) & (i < F.length(digits))),
        lambda i: F.conv(F.substring(digits, i + 1, F.lit(4)), 16, 10).cast("long"),
    )
    unsigned = F.aggregate(units, F.lit(0).cast("long"), lambda h, u: (h * 31 + u) % F.lit(2**32))
    return F.when(unsigned >= 2**31, unsigned - 2**32).otherwise(unsigned)


def pair_hash(one: Column, other: Column) -> Column:
    """A number below 2^52 that depends on an ordered pair of names only."""
    return F.conv(F.substring(F.md5(F.concat(one, F.lit("/"), other)), 1, 13), 16, 10).cast("long")


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys only, so retried tasks repeat it."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
