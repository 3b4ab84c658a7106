"""Column expressions shared by the operators. All of them stay inside Catalyst (no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def patient_id(barcode: Column | str, length: int = 12) -> Column:
    """First `length` characters of a sample barcode: the part that names the patient."""
    return F.substring(barcode, 1, length)


def rounded(value: Column | str, digits: int = 6) -> Column:
    return F.round(value, digits)


def significant(value: Column | str, digits: int = 10) -> Column:
    """The value to a number of significant digits, whatever its unit; zeros, infinities and NaN stay."""
    value = F.col(value) if isinstance(value, str) else value
    scale = F.pow(F.lit(10.0), digits - 1 - F.greatest(F.floor(F.log10(F.abs(value))), F.lit(-280)))
    plain = (value == 0) | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(plain, value).otherwise(F.rint(value * scale) / scale)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def clean_probability(p: Column) -> Column:
    """NaN and missing become 0, +inf becomes 1, -inf becomes 0; anything else is kept."""
    return (F.when(p.isNull() | F.isnan(p), F.lit(0.0))
            .when(p == F.lit(float("inf")), F.lit(1.0))
            .when(p == F.lit(float("-inf")), F.lit(0.0))
            .otherwise(p))


def feature_budget(width: Column, fraction: Column) -> Column:
    """Number of features a fraction of the width buys, never less than one."""
    return F.greatest(F.lit(1), F.floor(width * fraction).cast("int"))


def unit_hash(text: Column) -> Column:
    """A number in [0, 1) that depends only on the text, equal on every engine with md5."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def safe_ratio(top: Column, bottom: Column, otherwise: float | None = 0.0) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(otherwise).cast("double"))


def digamma(n: Column) -> Column:
    """psi(n) for a positive integer n, by six recurrence steps and the asymptotic series.

    The series is the textbook one: ln y - 1/2y - 1/12y^2 + 1/120y^4 - 1/252y^6 + 1/240y^8 - 1/132y^10.
    """
    n = n.cast("double")
    y = n + F.lit(6.0)
    inv = F.lit(1.0) / y
    sq = inv * inv
    shift = sum((F.lit(1.0) / (n + F.lit(float(j))) for j in range(1, 6)), F.lit(1.0) / n)
    tail = sq * (F.lit(1 / 12) - sq * (F.lit(1 / 120) - sq * (F.lit(1 / 252)
                 - sq * (F.lit(1 / 240) - sq * F.lit(1 / 132)))))
    return F.log(y) - inv / 2 - tail - shift
