"""Number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoscribe.functions.text import _c, let


def fixed(value: str | Column, digits: int) -> Column:
    """Text with ``digits`` decimals, rounded from the exact binary value (ties to even).

    ``format_string`` rounds the shortest decimal form of a double half up, which differs on values
    such as 0.15. Here the product with the power of ten is kept with its rounding error.
    """
    scale = F.lit(float(10 ** digits))

    def halves(x: Column) -> Column:
        big = x * F.lit(134_217_729.0)  # 2**27 + 1 splits a double into two halves
        return F.struct(x.alias("x"), (x * scale).alias("p"), (big - (big - x)).alias("high"))

    def units(h: Column) -> Column:
        error = (h["high"] * scale - h["p"]) + (h["x"] - h["high"]) * scale
        return F.struct(F.floor(h["p"]).alias("n"), ((h["p"] - F.floor(h["p"]) - F.lit(0.5)) + error).alias("past"))

    def rounded(u: Column) -> Column:
        return u["n"] + F.when((u["past"] > 0) | ((u["past"] == 0) & (u["n"] % 2 == 1)), F.lit(1)).otherwise(F.lit(0))

    def text(n: Column) -> Column:
        whole = F.floor(n / F.lit(10 ** digits)).cast("string")
        return whole if digits == 0 else F.concat(
            whole, F.lit("."), F.lpad((n % F.lit(10 ** digits)).cast("string"), digits, "0"))

    v = _c(value).cast("double")
    body = let(let(let(let(F.abs(v), halves), units), rounded), text)
    return F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), body)


def mtok(tokens: str | Column) -> Column:
    return _c(tokens) / F.lit(1e6)


def format_tokens(tokens: str | Column) -> Column:
    """``999``, ``1.5k``, ``2.50M``."""
    n = _c(tokens)
    return (F.when((n >= 0) & (n < 1_000), n.cast("string"))
            .when((n >= 1_000) & (n < 1_000_000), F.concat(fixed(n / F.lit(1e3), 1), F.lit("k")))
            .otherwise(F.concat(fixed(n / F.lit(1e6), 2), F.lit("M"))))


def format_bytes(size: str | Column) -> Column:
    """Decimal file-size text: ``512 bytes``, ``12 KB``, ``3.4 MB``, ``1.25 GB``."""
    n = _c(size)
    return (F.when(n < 1_000, F.concat(n.cast("string"), F.lit(" bytes")))
            .when(n < 1_000_000, F.concat(fixed(n / F.lit(1e3), 0), F.lit(" KB")))
            .when(n < 1_000_000_000, F.concat(fixed(n / F.lit(1e6), 1), F.lit(" MB")))
            .when(n < 1_000_000_000_000, F.concat(fixed(n / F.lit(1e9), 2), F.lit(" GB")))
            .otherwise(F.concat(fixed(n / F.lit(1e12), 2), F.lit(" TB"))))


def percent_text(fraction: str | Column) -> Column:
    return F.concat(fixed(_c(fraction) * F.lit(100.0), 1), F.lit("%"))


def whole_percent(fraction: str | Column) -> Column:
    """Fraction as a percentage, cut to a whole number."""
    return (_c(fraction) * F.lit(100.0)).cast("long")
