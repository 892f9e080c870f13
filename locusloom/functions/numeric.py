"""Number parsing, printing and small statistics as Columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from locusloom.functions.genotype import ColumnOrName, _c

# Plain decimal and exponent notation only: Spark's own cast also takes blanks, ``1.5d`` and ``nan``.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_double(text: ColumnOrName) -> Column:
    t = _c(text)
    return F.when(t.rlike(NUMBER_PATTERN), t.cast("double"))


def parse_position(text: ColumnOrName) -> Column:
    """Unsigned integer, NULL when it is none or does not fit a BIGINT."""
    t = _c(text)
    return F.when(t.rlike(r"^\+?[0-9]+$"), t.try_cast("bigint"))


def is_finite(value: ColumnOrName) -> Column:
    v = _c(value)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def fixed_decimals(value: ColumnOrName, places: int) -> Column:
    """Print with a fixed number of decimals, rounding the exact binary value, ties to even.

    ``value * 10^places`` is kept as an unrounded sum ``hi + lo`` (the value is split into two
    26-bit halves, whose products with a power of ten are exact), so 1.0005, which is stored a
    little below its text, prints as 1.000 and 0.0625 as 0.062. Only the part after the point, which
    is exact, is scaled; whole parts may be any below 2^63. NaN prints as ``NaN``, beyond 2^63 as ``inf``.

    Values from 0 to 4096 whose product is a thousandth or more away from a tie, as nearly all are, need none of this: the
    product is off by less than a millionth there, and is rounded as it is, in generated code.
    """
    if not 0 < places <= 6:
        raise ValueError("places must be 1..6")
    scale = 10 ** places
    v = _c(value)
    plain = F.abs(v) < F.lit(2.0 ** 63)

    def digits(x: Column) -> Column:
        """Text of a number from 0 on. Every step is bound to a name of its own, so that none is written out again."""
        return _let(x - F.floor(x), lambda part: _let(part * F.lit(134217729.0), lambda big: _let(big - (big - part), lambda head: _let(
            head * F.lit(float(scale)), lambda hi: _let((part - head) * F.lit(float(scale)), lambda lo: _let(
                _rounded(hi, lo), lambda n: F.concat(
                    (x.cast("bigint") + F.when(n == scale, F.lit(1)).otherwise(F.lit(0))).cast("string"), F.lit("."),
                    F.lpad((n % scale).cast("string"), places, "0"))))))))

    x = F.abs(F.when(plain, v).otherwise(F.when(v.isNotNull(), F.lit(0.0))))
    number = F.when(F.isnan(v), F.lit("NaN")).when(~plain, F.lit("inf")).otherwise(_let(x, digits))
    exact = F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), number)
    product = v * F.lit(float(scale))
    n = F.rint(product).cast("bigint")
    usual = F.concat(((n - n % scale) / scale).cast("bigint").cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), places, "0"))
    return F.when((v >= 0) & (v < 4096) & (F.abs(product - F.floor(product) - 0.5) > 0.001), usual).otherwise(exact)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rounded(hi: Column, lo: Column) -> Column:
    """hi + lo to the nearest whole number, ties to even; lo is far below 1."""
    def near(base: Column) -> Column:
        up, down, odd = F.lit(0.5) - (hi - base), F.lit(-0.5) - (hi - base), (base % 2) == 1
        step = F.when((lo > up) | ((lo == up) & odd), F.lit(1.0)).when((lo < down) | ((lo == down) & odd), F.lit(-1.0)).otherwise(F.lit(0.0))
        return (base + step).cast("bigint")

    return _let(F.rint(hi), near)


def normal_cdf(z: ColumnOrName) -> Column:
    """Normal distribution function, Abramowitz and Stegun 7.1.26 (error below 1.5e-7)."""
    v = _c(z)
    x = F.abs(v) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = F.lit(1.0) - poly * F.exp(-x * x)
    return F.when(v >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def normal_density(z: ColumnOrName) -> Column:
    v = _c(z)
    return F.exp(-v * v / 2) / F.lit(math.sqrt(2.0 * math.pi))


def density_series(lowest: float = -4.0, highest: float = 4.0, step: float = 0.1) -> Column:
    """ARRAY<STRUCT<z, density>> for a bell-curve chart."""
    count = int(round((highest - lowest) / step))
    points = F.sequence(F.lit(0), F.lit(count))

    def point(i: Column) -> Column:
        z = F.round(F.lit(lowest) + i * F.lit(step), 6)
        return F.struct(z.alias("z"), normal_density(z).alias("density"))

    return F.transform(points, point)


def trait_correlation(r2: ColumnOrName) -> Column:
    return F.sqrt(_c(r2))


def predicted_trait_z(r2: ColumnOrName, z: ColumnOrName) -> Column:
    return trait_correlation(r2) * _c(z)


def predicted_trait_value(r2: ColumnOrName, z: ColumnOrName, sd: ColumnOrName, mean: ColumnOrName) -> Column:
    """Trait value expected for a score z: sqrt(R2) * z * sd + mean."""
    return predicted_trait_z(r2, z) * _c(sd) + _c(mean)
