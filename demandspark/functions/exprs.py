"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Rational approximation of the inverse normal distribution
# (Acklam), highest power first.
_CENTRAL_NUM = (
    -3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2,
    1.383577518672690e2, -3.066479806614716e1, 2.506628277459239e0,
)
_CENTRAL_DEN = (
    -5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2,
    6.680131188771972e1, -1.328068155288572e1, 1.0,
)
_TAIL_NUM = (
    -7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838e0,
    -2.549732539343734e0, 4.374664141464968e0, 2.938163982698783e0,
)
_TAIL_DEN = (
    7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996e0,
    3.754408661907416e0, 1.0,
)
_TAIL_CUT = 0.02425
_Z_95 = 1.6448536269514722


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def z_service(level: Column) -> Column:
    """Standard-normal quantile of a service level; an error outside (0, 1)."""
    lower = F.sqrt(F.lit(-2.0) * F.log(level))
    upper = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - level))
    mid = level - F.lit(0.5)
    central = _horner(_CENTRAL_NUM, mid * mid) * mid / _horner(_CENTRAL_DEN, mid * mid)
    return (
        F.when(
            (level <= 0) | (level >= 1) | level.isNull(),
            F.raise_error(F.lit("service level must lie in (0, 1)")).cast("double"),
        )
        .when(F.abs(level - F.lit(0.95)) < 1e-12, F.lit(_Z_95))
        .when(level < _TAIL_CUT, _horner(_TAIL_NUM, lower) / _horner(_TAIL_DEN, lower))
        .when(level <= 1.0 - _TAIL_CUT, central)
        .otherwise(-_horner(_TAIL_NUM, upper) / _horner(_TAIL_DEN, upper))
    )


def ratio(num: Column, den: Column) -> Column:
    """num / den as a double; NULL when the denominator is 0 or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def _whole(x: Column) -> Column:
    """A whole number as a decimal, so that products are exact up to 38 digits."""
    return x.try_cast("decimal(38,0)")


def exact_variance(n: Column, total: Column, squares: Column) -> Column:
    """Sample variance from n and the sums of whole numbers and of their squares; NULL below two values.

    n * squares - total^2 is taken in decimals of 38 digits, so nothing
    cancels. Where a product has more digits it is the difference of doubles.
    """
    exact = F.try_subtract(F.try_multiply(_whole(n), _whole(squares)), F.try_multiply(_whole(total), _whole(total)))
    rough = n.cast("double") * squares.cast("double") - total.cast("double") * total.cast("double")
    return F.try_divide(F.coalesce(exact.cast("double"), rough), n.cast("double") * (n.cast("double") - 1))


def exact_day_slope(first: Column, last: Column, total: Column, products: Column) -> Column:
    """Least-squares slope over every day from first to last, from the sums of units and of day times units.

    Twice the covariance sum is the whole number 2 * products - total * (first
    + last), exact in decimals and in doubles beyond them as `exact_variance` is.
    """
    n = (last - first + 1).cast("double")
    ends = (first + last).cast("long")
    exact = F.try_subtract(F.try_multiply(_whole(F.lit(2)), _whole(products)), F.try_multiply(_whole(total), _whole(ends)))
    rough = 2 * products.cast("double") - total.cast("double") * ends.cast("double")
    return F.try_divide(F.coalesce(exact.cast("double"), rough), n * (n * n - 1) / F.lit(6.0))


def pct_change(now: Column, before: Column) -> Column:
    """Percent change rounded to 2 places; NULL without a non-zero base."""
    return F.round((ratio(now, before) - 1) * 100, 2)


def pct_change_positive_base(now: Column, before: Column) -> Column:
    return F.when(before > 0, pct_change(now, before))


def share_pct(part: Column, whole: Column) -> Column:
    return F.round(ratio(part, whole) * 100, 4)


def tier(score: Column, tiers: tuple[tuple[float, str], ...]) -> Column:
    """First label whose threshold the score reaches; thresholds descend."""
    expr = None
    for cut, label in tiers[:-1]:
        hit = score >= cut
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    return expr.otherwise(tiers[-1][1])


def scaled(x: Column, places: int = 4) -> Column:
    """A rounded value as a whole number, so that sums do not depend on order."""
    return F.round(x * F.lit(float(10**places))).cast("long")


def mean_of_scaled(total: Column, n: Column, places: int = 4) -> Column:
    """Mean, rounded to `places`, of values summed with `scaled`."""
    return F.round(ratio(total, n)) / F.lit(float(10**places))


def unscaled(total: Column, places: int = 4) -> Column:
    return total / F.lit(float(10**places))


def exact_mean(x: Column, stored: int = 4, places: int = 6) -> Column:
    """Mean of values stored with `stored` places, rounded to `places`.

    Sums whole numbers, so the result does not depend on the order of rows.
    """
    total = F.sum(scaled(x, stored)) * F.lit(10 ** (places - stored))
    return F.round(ratio(total, F.count(x))) / F.lit(float(10**places))
