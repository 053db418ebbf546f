"""Scores of probabilities and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import lookup, quantiles
from .exposure import spearman


def binned(rows: DataFrame, p: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Equal-count bins by linear quantile edges, right-closed, equal edges merged."""
    by = list(by)
    probs = {f"_e{i}": i / bins for i in range(bins + 1)}
    edges = quantiles(rows, by, p, probs)
    cut = F.array_sort(F.array_distinct(F.array(*[F.col(e) for e in probs])))
    edges = edges.select(*by, cut.alias("_edges"))
    joined = lookup(rows, edges, by) if by else rows.join(edges)
    inner = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
    return joined.withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col(p)))).drop("_edges")


def reliability(rows: DataFrame, y: str, p: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Per bin: rows, positives, summed and mean prediction, observed rate, relative residual."""
    return binned(rows, p, by, bins).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("o"), F.sum(p).alias("e"),
        F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("observed"),
        (F.sum(F.col(y).cast("double")) / F.sum(p) - 1).alias("relative_residual"))


def hosmer_lemeshow(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    o, e, n = F.col("o"), F.col("e"), F.col("n")
    return bins.groupBy(*by).agg(F.sum((o - e) * (o - e) / (e * (1 - e / n))).alias("hl"))


def probability_scores(rows: DataFrame, y: str, p: str, by: Sequence[str] = (),
                       flag_at: float = 0.1) -> DataFrame:
    """Rows, base rate, mean prediction, relative miss and its flag, Brier score and log loss."""
    yes, q = F.col(y).cast("double"), F.col(p)
    eps = 2.220446049250313e-16
    safe = F.least(F.greatest(q, F.lit(eps)), F.lit(1 - eps))
    loss = -(yes * F.log(safe) + (1 - yes) * F.log(1 - safe))
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(y).cast("long")).alias("positives"),
        F.avg(yes).alias("base_rate"), F.avg(q).alias("mean_p"),
        F.avg((q - yes) * (q - yes)).alias("brier"), F.avg(loss).alias("log_loss"))
    out = out.withColumn("miss", F.try_divide(F.col("mean_p") - F.col("base_rate"), F.col("base_rate")))
    return out.withColumn("flagged", F.abs("miss") > flag_at)


def spread(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows, mean, median and outer deciles."""
    plain = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return plain.join(quantiles(rows, by, value, {"median": 0.5, "p10": 0.1, "p90": 0.9}), list(by))


def logit(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def recalibrated(p: Column, intercept: Column, slope: Column) -> Column:
    return 1 / (1 + F.exp(-(intercept + slope * logit(p))))


def routed(full: DataFrame, out_of_fold: DataFrame, keys: Sequence[str], p: str,
           coefficients: DataFrame, by: Sequence[str], name: str = "calibrated") -> DataFrame:
    """The out-of-fold prediction where there is one, else the fit's own, then recalibrated."""
    oof = out_of_fold.select(*keys, F.col(p).alias("_oof"))
    out = lookup(full, oof, keys).withColumn("used", F.coalesce("_oof", p)).drop("_oof")
    out = lookup(out, coefficients, by)
    return out.withColumn(name, recalibrated(F.col("used"), F.col("intercept"), F.col("slope")))


def error_scores(rows: DataFrame, target: str, predictors: Sequence[str], noise: str,
                 subsets: Column, base: str) -> DataFrame:
    """Per subset and predictor: squared error less the target's own variance, its ratio and the
    raw ratio to a base predictor, rank correlation and fitted line. ``subsets`` is an array of
    the (possibly overlapping) subset names a row is in."""
    long = rows.select(F.explode(subsets).alias("subset"), target, noise, *predictors)
    long = long.unpivot(["subset", target, noise], list(predictors), "predictor", "value")
    t, x = F.col(target), F.col("value")
    flat = F.max(x) == F.min(x)
    per = long.groupBy("subset", "predictor").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum((t - x) * (t - x)).alias("sse"),
        F.sum(noise).alias("_noise"), F.when(~flat, F.regr_slope(t, x)).alias("slope"),
        F.when(~flat, F.regr_intercept(t, x)).alias("intercept"))
    per = per.withColumn("tse", F.col("sse") - F.col("_noise"))
    ref = per.filter(F.col("predictor") == base).select(
        "subset", F.col("tse").alias("_t"), F.col("sse").alias("_s"))
    out = per.join(ref, "subset").withColumns(
        {"tse_ratio": F.col("tse") / F.col("_t"), "raw_ratio": F.col("sse") / F.col("_s")})
    rho = spearman(long, ["subset", "predictor"], "value", target)
    return out.join(rho, ["subset", "predictor"]).drop("_t", "_s", "_noise")


def error_records(predictions: DataFrame, by: Sequence[str], target: str, value: str,
                  noise: str) -> DataFrame:
    t, x = F.col(target), F.col(value)
    return predictions.groupBy(*by).agg(
        F.sum((t - x) * (t - x)).alias("sse"), F.sum(noise).alias("noise"), F.count(F.lit(1)).alias("rows"))


def model_ratios(records: DataFrame, by: Sequence[str], models: Sequence[str], value: str,
                 pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Models to columns, then each compared pair's ratio and difference back to rows."""
    wide = records.groupBy(*by).pivot("model", list(models)).agg(F.first(value))
    cells = F.array(*[F.struct(
        F.lit(f"{a}/{b}").alias("comparison"), (F.col(a) / F.col(b)).alias("ratio"),
        (F.col(a) - F.col(b)).alias("difference")) for a, b in pairs])
    return wide.select(*by, F.inline(cells))


def percentile_intervals(draws: DataFrame, by: Sequence[str], value: str = "value",
                         low: float = 0.025, high: float = 0.975) -> DataFrame:
    return quantiles(draws, by, value, {"p2_5": low, "p97_5": high, "median": 0.5})


def chosen_depth(ll_a: Column, hl_a: Column, ll_b: Column, hl_b: Column, a: str, b: str) -> Column:
    """``b`` only when no worse on log loss and strictly better on the other; ``a`` when better or
    equal on both; else mixed."""
    return (F.when((ll_b <= ll_a) & (hl_b < hl_a), b)
            .when((ll_a <= ll_b) & (hl_a <= hl_b), a).otherwise("mixed"))


def verdicts(draws: DataFrame, points: DataFrame, by: Sequence[str], pass_share: float = 0.975,
             value: str = "value") -> DataFrame:
    """Point estimate, interval, draws below zero and whether enough of them are (ties against)."""
    below = draws.groupBy(*by).agg(
        F.count_if(F.col(value) < 0).alias("below"), F.count(F.lit(1)).alias("draws"))
    out = points.join(percentile_intervals(draws, by, value), list(by)).join(below, list(by))
    return out.withColumn("passes", F.col("below") >= F.lit(pass_share) * F.col("draws"))
