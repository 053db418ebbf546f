"""Small statistical models fitted from distributed sums.

Rows never leave the executors: each group's cross products are combined by a normal aggregate,
a p-by-p solve runs on the aggregated rows, one per group, and coefficients are looked up again.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import group_values, lookup, settled
from ..session import checkpointed
from .scoring import logit

PER90_SQUARED = 8100.0


def gram(rows: DataFrame, by: Sequence[str], inputs: Sequence[Column], weight: Column | None = None,
         extra: Sequence[Column] = ()) -> DataFrame:
    """Per group the upper triangle of the inputs' weighted cross products as one array."""
    w = F.lit(1.0) if weight is None else weight
    cells = [F.sum(w * a * b) for i, a in enumerate(inputs) for b in inputs[i:]]
    return rows.groupBy(*by).agg(F.array(*cells).alias("gram"), F.count(F.lit(1)).alias("m"), *extra)


def _square(flat, size):
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = flat
    return out + np.triu(out, 1).T


def least_squares(rows: DataFrame, by: Sequence[str], x: Sequence[Column], y: Column,
                  weight: Column | None = None) -> DataFrame:
    """Coefficients, residual and total sum of squares and R² per group.

    y and the inputs are centred on the group's means before the sums, so that little is lost
    when the residual is small; the constant is added to the inputs here.
    """
    by, p = list(by), len(x)
    named = rows.select(*by, *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(x)],
                        y.cast("double").alias("_y"),
                        (F.lit(1.0) if weight is None else weight).alias("_w"))
    named = named.dropna(subset=[*[f"_x{i}" for i in range(p)], "_y"])
    columns = [*[f"_x{i}" for i in range(p)], "_y"]
    means = {f"_m{c}": F.sum(F.col("_w") * F.col(c)) / F.sum("_w") for c in columns}
    centred = group_values(named, by, **means) if by else named.join(
        named.agg(*[c.alias(n) for n, c in means.items()]))
    parts = [F.col(c) - F.col(f"_m{c}") for c in columns]
    extra = [F.array(*[F.first(f"_m{c}") for c in columns]).alias("means")]
    sums = gram(centred, by, parts, F.col("_w"), extra)

    @F.pandas_udf(T.StructType([T.StructField("coefficients", T.ArrayType(T.DoubleType())),
                                T.StructField("rss", T.DoubleType()), T.StructField("tss", T.DoubleType())]))
    def solve(flat: pd.Series, mean: pd.Series) -> pd.DataFrame:
        out = []
        for g, m in zip(flat, mean):
            s = _square(g, p + 1)
            b = np.linalg.pinv(s[:p, :p]) @ s[:p, p]
            rss = s[p, p] - 2 * b @ s[:p, p] + b @ s[:p, :p] @ b
            out.append(([float(m[p] - b @ np.asarray(m[:p])), *map(float, b)], max(rss, 0.0), s[p, p]))
        return pd.DataFrame(out, columns=["coefficients", "rss", "tss"])

    solved = sums.select(*by, "m", solve("gram", "means").alias("_s"))
    return solved.select(*by, "m", "_s.*", F.try_divide(
        F.col("_s.tss") - F.col("_s.rss"), F.col("_s.tss")).alias("r_squared"))


def linear(coefficients: Column, x: Sequence[Column]) -> Column:
    out = F.get(coefficients, F.lit(0))
    for i, c in enumerate(x):
        out = out + F.get(coefficients, F.lit(i + 1)) * c
    return out


def with_residuals(rows: DataFrame, fits: DataFrame, by: Sequence[str], x: Sequence[Column], y: Column,
                   name: str = "residual") -> DataFrame:
    """Each row less its group's fitted value; null where the row lacks an input."""
    c = fits.select(*by, "coefficients")
    joined = lookup(rows, c, by) if by else rows.join(c)
    return joined.withColumn(name, y - linear(F.col("coefficients"), x)).drop("coefficients")


def player_dispersion(rows: DataFrame, keys: Sequence[str], values: Sequence[str],
                      minutes: str = "minutes") -> DataFrame:
    """Per key its games with minutes, their minutes, and the weighted squares around its rate.

    One pass: the squares are sum v²/m less (sum v)²/sum m.
    """
    m = F.col(minutes)
    played = rows.filter(m > 0)
    return played.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(minutes).alias("m"),
        *[F.sum(v).alias(f"sum_{v}") for v in values],
        *[(F.sum(F.col(v) * F.col(v) / m) - F.sum(v) * F.sum(v) / F.sum(minutes)).alias(f"s_{v}")
          for v in values])


def group_dispersion(stats: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """phi per group: summed squares over summed (n - 1)."""
    out = stats.groupBy(group).agg(
        F.count(F.lit(1)).alias("players"), F.sum(F.col("n") - 1).alias("df"),
        *[F.sum(f"s_{v}").alias(f"s_{v}") for v in values])
    return out.withColumns({f"phi_{v}": F.try_divide(F.col(f"s_{v}"), F.col("df")) for v in values})


def sampling_variance(phi: Column, minutes: Column) -> Column:
    return PER90_SQUARED * phi / minutes


def split_half(rows: DataFrame, keys: Sequence[str], group: str, value: str, day: str, phi: DataFrame,
               minutes: str = "minutes") -> DataFrame:
    """Squared gaps between odd and even days' rates, against what the dispersion implies."""
    odd, m = F.col(day) % 2 == 1, F.col(minutes)
    per = rows.filter(m > 0).groupBy(*keys, group).agg(*[
        F.sum(F.when(c, F.col(x))).alias(f"_{n}_{h}")
        for h, c in (("odd", odd), ("even", ~odd)) for n, x in (("v", value), ("m", minutes))])
    per = lookup(per.filter("_m_odd > 0 and _m_even > 0"), phi, [group], "inner")
    gap = 90 * F.col("_v_odd") / F.col("_m_odd") - 90 * F.col("_v_even") / F.col("_m_even")
    due = PER90_SQUARED * F.col("phi") * (1 / F.col("_m_odd") + 1 / F.col("_m_even"))
    out = per.groupBy(group).agg(F.count(F.lit(1)).alias("players"), F.sum(gap * gap).alias("observed"),
                                 F.sum(due).alias("expected"))
    return out.withColumn("ratio", F.col("observed") / F.col("expected"))


def shrinkage_fits(rows: DataFrame, by: Sequence[str], inputs: Sequence[Column], y: Column,
                   psi: Column, weight: Column | None = None) -> DataFrame:
    """Per group the between-entity variance and the weighted fit of y on the inputs.

    The inputs span the constant. tau² is moment-based: residual squares of the plain fit less
    sum (1 - h) psi, over rows less columns, not below 0. Both sums come from cross products:
    sum (1 - h) psi is sum psi less the trace of the inverse times the psi-weighted products.
    Groups with no more rows than columns, or without any variance at all, stay out.
    """
    by, p = list(by), len(inputs)
    w = F.lit(1.0) if weight is None else weight
    named = rows.select(*by, *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(inputs)],
                        y.cast("double").alias("_y0"), psi.cast("double").alias("_psi"), w.alias("_w"))
    # y is centred on its group's mean first: residual squares by subtraction lose digits otherwise
    named = group_values(named, by, _mean=F.sum(F.col("_w") * F.col("_y0")) / F.sum("_w"))
    # read by two passes, so stored in between
    named = checkpointed(named.withColumn("_y", F.col("_y0") - F.col("_mean")))
    x = [F.col(f"_x{i}") for i in range(p)]
    first = named.groupBy(*by).agg(
        F.array(*[F.sum(F.col("_w") * a * b) for i, a in enumerate([*x, F.col("_y")])
                  for b in [*x, F.col("_y")][i:]]).alias("gram"),
        F.array(*[F.sum(F.col("_w") * F.col("_psi") * a * b) for i, a in enumerate(x) for b in x[i:]]).alias("noise"),
        F.sum(F.col("_w") * F.col("_psi")).alias("psi"), F.sum("_w").alias("m"), F.first("_mean").alias("mean"))

    @F.pandas_udf("struct<tau2 double, moment double>")
    def variance(flat: pd.Series, noise: pd.Series, total: pd.Series, m: pd.Series) -> pd.DataFrame:
        out = []
        for g, z, s_psi, n in zip(flat, noise, total, m):
            s, q = _square(g, p + 1), _square(z, p)
            inverse = np.linalg.pinv(s[:p, :p])
            b = inverse @ s[:p, p]
            rss = max(s[p, p] - b @ s[:p, p], 0.0)
            moment = (rss - (s_psi - np.trace(inverse @ q))) / (n - p) if n > p else 0.0
            out.append((max(0.0, moment), moment))
        return pd.DataFrame(out, columns=["tau2", "moment"])

    tau = first.filter(F.col("m") > p).select(
        *by, "m", "mean", variance("gram", "noise", "psi", "m").alias("_t")).select(*by, "m", "mean", "_t.*")
    second = lookup(named, tau.select(*by, "tau2"), by, "inner").filter(F.col("tau2") + F.col("_psi") > 0)
    weighted = gram(second, by, [*x, F.col("_y")], F.col("_w") / (F.col("tau2") + F.col("_psi")))

    @F.pandas_udf("array<double>")
    def coefficients(flat: pd.Series) -> pd.Series:
        out = []
        for g in flat:
            s = _square(g, p + 1)
            out.append((np.linalg.pinv(s[:p, :p]) @ s[:p, p]).tolist())
        return pd.Series(out)

    b = weighted.select(*by, coefficients("gram").alias("coefficients"))
    return tau.join(b, by)


def shrunk(rows: DataFrame, fits: DataFrame, by: Sequence[str], inputs: Sequence[Column], y: Column,
           psi: Column) -> DataFrame:
    """Fitted value, shrinkage weight, posterior mean and its sd; null in groups without a fit."""
    joined = lookup(rows, fits.select(*by, "tau2", "mean", "coefficients"), by)
    xb = F.col("mean")
    for i, c in enumerate(inputs):
        xb = xb + F.get("coefficients", F.lit(i)) * c
    tau2 = F.col("tau2")
    shrink = F.try_divide(tau2, tau2 + psi)
    out = joined.withColumns({"xb": xb, "shrink": shrink})
    return out.withColumns({
        "theta": F.col("xb") + F.col("shrink") * (y - F.col("xb")),
        "sd": F.sqrt(F.try_divide(tau2 * psi, tau2 + psi))}).drop("mean", "coefficients")


def league_inputs(league: str, leagues: Sequence, minutes: str | None = None) -> list[Column]:
    """Indicator columns per league and, with minutes, the log of their thousands."""
    out = [(F.col(league) == x).cast("double") for x in leagues]
    return out + ([F.log(F.col(minutes) / 1000.0)] if minutes else [])


def reliability_at(fits: DataFrame, phi: DataFrame, by: Sequence[str], at: Sequence[float]) -> DataFrame:
    """tau² / (tau² + psi) at given minutes."""
    out = fits.join(phi, list(by))
    for m in at:
        psi = sampling_variance(F.col("phi"), F.lit(m))
        out = out.withColumn(f"at_{m:g}", F.try_divide(F.col("tau2"), F.col("tau2") + psi))
    return out


def logistic_recalibration(rows: DataFrame, by: Sequence[str], y: str, p: str, steps: int = 60,
                           tolerance: float = 1e-10, falling: bool = False) -> DataFrame:
    """Intercept and slope of y on logit p per group, unpenalised, by Newton steps.

    A step is one aggregate of five sums per group over all rows; only a step's coefficients, one
    row per group, come to the driver. Stops when a group's slope is not above 0: such p order the
    outcomes the wrong way round and cannot be recalibrated. `falling` takes those as they are.
    """
    by = list(by)
    data = settled(rows.select(*by, logit(F.col(p)).alias("_x"), F.col(y).cast("double").alias("_y")))
    spark = rows.sparkSession
    coefs = data.select(*by).distinct().withColumns({"intercept": F.lit(0.0), "slope": F.lit(1.0)})
    for _ in range(steps):
        q = 1 / (1 + F.exp(-(F.col("intercept") + F.col("slope") * F.col("_x"))))
        w, r, x = q * (1 - q), F.col("_y") - q, F.col("_x")
        sums = lookup(data, coefs, by, "inner").groupBy(*by, "intercept", "slope").agg(
            F.sum(r).alias("_r"), F.sum(r * x).alias("_rx"), F.sum(w).alias("_w"),
            F.sum(w * x).alias("_wx"), F.sum(w * x * x).alias("_wxx"))
        det = F.col("_w") * F.col("_wxx") - F.col("_wx") * F.col("_wx")
        da = F.try_divide(F.col("_wxx") * F.col("_r") - F.col("_wx") * F.col("_rx"), det)
        db = F.try_divide(F.col("_w") * F.col("_rx") - F.col("_wx") * F.col("_r"), det)
        # a step is held to 2, as a full one can overshoot on few rows
        da, db = (F.greatest(F.lit(-2.0), F.least(F.lit(2.0), c)) for c in (da, db))
        stepped = sums.select(*by, (F.col("intercept") + F.coalesce(da, F.lit(0.0))).alias("intercept"),
                              (F.col("slope") + F.coalesce(db, F.lit(0.0))).alias("slope"),
                              F.greatest(F.abs(da), F.abs(db)).alias("_step"))
        found = stepped.collect()
        coefs = spark.createDataFrame(found, stepped.schema).drop("_step")
        if all((f["_step"] or 0.0) < tolerance for f in found):
            break
    else:
        raise RuntimeError(f"no convergence in {steps} steps, as with outcomes that p separates")
    wrong = [f.asDict() for f in found if f["slope"] <= 0]
    if wrong and not falling:
        raise ValueError(f"slope not above 0: {wrong[:3]}")
    return coefs
