"""Scalar functions as Catalyst expressions: costs, ratios, normal distribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The default execution costs.
COSTS = {"per_share": 0.005, "min_ticket": 1.0, "pct": 0.0001, "slip_bps": 2.0, "spread_bps": 3.0, "eta": 0.1, "impact": True, "participation": 0.0, "borrow": 0.0}
#: The costs that a multiplier scales; the participation cap and the impact switch stay.
SCALED = ("per_share", "min_ticket", "pct", "slip_bps", "spread_bps", "eta", "borrow")


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def slippage(price, quantity, volume, costs: dict = COSTS) -> Column:
    """Dollars a share: a fixed part, and an impact with the square root of the order's part of the volume."""
    impact = F.when(_col(volume) > 0, F.lit(float(costs["eta"])) * F.sqrt(_col(quantity) / _col(volume))).otherwise(0.0) if costs["impact"] else F.lit(0.0)
    return _col(price) * (F.lit(costs["slip_bps"] * 1e-4) + impact)


def half_spread(price, costs: dict = COSTS) -> Column:
    return _col(price) * F.lit(costs["spread_bps"] * 1e-4 / 2)


def execution_price(price, quantity, volume, buy: Column, costs: dict = COSTS) -> Column:
    more = half_spread(price, costs) + slippage(price, quantity, volume, costs)
    return F.when(buy, _col(price) + more).otherwise(F.greatest(F.lit(0.0001), _col(price) - more))


def commission(quantity, executed, costs: dict = COSTS) -> Column:
    return F.greatest(F.lit(float(costs["min_ticket"])), _col(quantity) * costs["per_share"] + _col(quantity) * _col(executed) * costs["pct"])


def fillable(quantity, volume, cap) -> Column:
    """Whole shares within the cap on a bar's volume; all of them without cap or volume."""
    return F.when((_col(cap) > 0) & (_col(volume) > 0), F.least(_col(quantity), F.floor(_col(cap) * _col(volume)).cast("double"))).otherwise(_col(quantity))


def participation(quantity, volume) -> Column:
    return F.when(_col(volume) > 0, _col(quantity) / _col(volume)).otherwise(0.0)


def scale_costs(costs: dict, by: float) -> dict:
    return {k: v * by if k in SCALED else v for k, v in costs.items()}


def transaction_cost(commission, slip, quantity, spread) -> Column:
    return _col(commission) + _col(slip) * _col(quantity) + _col(spread)


def cagr(total_return, years) -> Column:
    r, y = _col(total_return), _col(years)
    return F.when(y <= 0, 0.0).when(r <= -1, -1.0).otherwise(F.pow(1 + r, 1 / F.nullif(y, F.lit(0.0))) - 1)


def calmar(growth, drawdown) -> Column:
    d = F.abs(_col(drawdown))
    return F.when(d <= 1e-9, 0.0).otherwise(F.try_divide(_col(growth), d))


def normal_pdf(x) -> Column:
    return F.exp(-_col(x) * _col(x) / 2) / F.sqrt(F.lit(2.0) * F.pi())


#: Rational approximation of the normal quantile (P. J. Acklam).
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ACKLAM_LOW = 0.02425


def _poly(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p) -> Column:
    """10 and -10 at and beyond the ends."""
    p = _col(p)
    q = p - 0.5
    r = q * q
    tail = F.sqrt(F.lit(-2.0) * F.ln(F.when(p < 0.5, p).otherwise(1 - p)))
    side = _poly(tail, ACKLAM_C) / _poly(tail, (*ACKLAM_D, 1.0))
    mid = _poly(r, ACKLAM_A) * q / _poly(r, (*ACKLAM_B, 1.0))
    return F.when(p <= 0, -10.0).when(p >= 1, 10.0).when(p < ACKLAM_LOW, side).when(p > 1 - ACKLAM_LOW, -side).otherwise(mid)


def normal_cdf(x) -> Column:
    """By a convergent series in the middle and a continued fraction outside; Spark has no erf. Good to about 1e-12."""
    x = _col(x)
    a = F.abs(x)
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(a.alias("t"), a.alias("s")), lambda acc, k: F.struct((acc["t"] * a * a / (2 * k + 1)).alias("t"), (acc["s"] + acc["t"] * a * a / (2 * k + 1)).alias("s")), lambda acc: acc["s"])
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), a, lambda acc, k: a + k / acc)
    upper = F.when(a < 5, 0.5 - normal_pdf(a) * terms).otherwise(normal_pdf(a) / fraction)
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def cornish_fisher(z, skew, excess) -> Column:
    z, s, k = _col(z), _col(skew), _col(excess)
    return z + s / 6 * (z * z - 1) + k / 24 * (z * z * z - 3 * z) - s * s / 36 * (2 * z * z * z - 5 * z)


def compact_dollars(x) -> Column:
    """An amount for a table: in the largest of T, M, k and so on that fits, to three digits, without a fraction where there is none."""
    x = _col(x)
    unit = F.when(x >= 1e12, 1e12).when(x >= 1e9, 1e9).when(x >= 1e6, 1e6).when(x >= 1e3, 1e3).otherwise(1.0)
    mark = F.when(x >= 1e12, "T").when(x >= 1e9, "B").when(x >= 1e6, "M").when(x >= 1e3, "k").otherwise("")
    v = x / unit
    shown = F.when((F.abs(v - F.round(v)) < 1e-9) | (v >= 100), F.format_string("%.0f", v)).when(v >= 10, F.format_string("%.1f", v)).otherwise(F.format_string("%.2f", v))
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "-").otherwise(F.concat(F.lit("$"), shown, mark))
