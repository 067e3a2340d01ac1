"""Column expressions shared by the operators. Everything stays inside codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(col: Column | str) -> Column:
    """Round to six places and turn -0.0 into 0.0."""
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double"), 6) + F.lit(0.0)


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as a double, null on a zero denominator."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return F.try_divide(num.cast("double"), den.cast("double"))


def draw_key(seed: Column, salt: str, *ident: Column) -> Column:
    """md5 of `seed|salt|id`: the same on every engine and for every partitioning."""
    parts = [c.cast("string") for c in ident]
    return F.md5(F.concat_ws("|", seed.cast("string"), F.lit(salt), *parts))


def hash60(key: Column) -> Column:
    """First 60 bits of a hex digest as a non-negative BIGINT."""
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint")


def unit(key: Column) -> Column:
    """A hex digest as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def student_t_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t for integer degrees of freedom.

    Finite trigonometric series (Abramowitz and Stegun 26.7.3 and 26.7.4).
    """
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    cos, sin = F.cos(theta), F.sin(theta)
    odd = df % 2 == 1
    terms = F.when(odd, (df - 1) / 2).otherwise(df / 2).cast("int")
    first = F.when(odd, cos).otherwise(F.lit(1.0))
    steps = F.when(terms > 1, F.sequence(F.lit(1), terms - 1)).otherwise(
        F.array().cast("array<int>")
    )

    def step(acc: Column, j: Column) -> Column:
        num = F.when(odd, 2 * j).otherwise(2 * j - 1).cast("double")
        den = F.when(odd, 2 * j + 1).otherwise(2 * j).cast("double")
        term = acc["term"] * num / den * cos * cos
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(
        steps, F.struct(first.alias("term"), first.alias("total")), step, lambda acc: acc["total"]
    )
    total = F.when(terms >= 1, total).otherwise(F.lit(0.0))
    p = F.when(odd, 1 - (2 / math.pi) * (theta + sin * total)).otherwise(1 - sin * total)
    return F.greatest(p, F.lit(0.0))


def erf(x: Column) -> Column:
    """Error function by its all-positive series; 1 to double precision from x = 6 on."""
    x = F.least(F.abs(x), F.lit(6.0))

    def step(acc: Column, n: Column) -> Column:
        term = acc["term"] * 2 * x * x / (2 * n + 1).cast("double")
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(200)),
        F.struct(x.alias("term"), x.alias("total")),
        step,
        lambda acc: acc["total"],
    )
    return F.least(F.lit(2 / math.sqrt(math.pi)) * F.exp(-x * x) * total, F.lit(1.0))


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal."""
    return F.when(z.isNotNull(), F.lit(1.0) - erf(F.abs(z) / F.lit(math.sqrt(2.0))))
