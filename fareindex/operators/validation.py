"""Comparison with a reference series: correlation, error, direction, lags, back-test, regression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fareindex.functions.aggregates import mape, pearson, share_true
from fareindex.functions.parsing import month_key
from fareindex.operators.series import average_rank, log_changes, ordered


def align(a: DataFrame, b: DataFrame, on="period", value: str = "value", keys=()) -> DataFrame:
    """(keys, period, x, y) of the periods both series have."""
    left = a.select(*keys, on, F.col(value).cast("double").alias("x"))
    return left.join(b.select(*keys, on, F.col(value).cast("double").alias("y")), [*keys, on])


def spearman(pairs: DataFrame, keys=()) -> DataFrame:
    ranked = pairs.withColumns({"rx": average_rank("x", keys), "ry": average_rank("y", keys)})
    return ranked.groupBy(*keys).agg(pearson(F.col("rx"), F.col("ry")).alias("spearman"))


def lag_pairs(pairs: DataFrame, max_lag: int = 3, on: str = "period", keys=()) -> DataFrame:
    """x(i) with y(i + lag) for each lag up to max_lag either way."""
    numbered = pairs.withColumn("i", F.row_number().over(ordered(on, keys)))
    lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))
    left = numbered.select(*keys, "x", "i", lags.alias("lag")).withColumn("j", F.col("i") + F.col("lag"))
    return left.join(numbered.select(*keys, "y", F.col("i").alias("j")), [*keys, "j"])


def cross_correlation(pairs: DataFrame, max_lag: int = 3, on: str = "period", keys=()) -> DataFrame:
    out = lag_pairs(pairs, max_lag, on, keys).groupBy(*keys, "lag").agg(F.round(pearson(F.col("x"), F.col("y")), 3).alias("r"), F.count("*").alias("n"))
    return out.orderBy(*keys, "lag")


def best_lag(correlations: DataFrame, keys=()) -> DataFrame:
    """The lag with the highest correlation; the lowest lag on ties."""
    return correlations.groupBy(*keys).agg(F.max_by("lag", F.struct(F.col("r"), -F.col("lag"))).alias("best_lag"), F.max("r").alias("best_r"))


def rebased_pairs(pairs: DataFrame, on: str = "period", keys=()) -> DataFrame:
    """Both series as 100 at the first common period, their gap and changes."""
    w = ordered(on, keys)
    out = pairs.withColumns({c: F.try_divide(F.col(s), F.first(s).over(w)) * 100 for c, s in (("a", "x"), ("b", "y"))})
    return out.withColumns({"gap": F.col("a") - F.col("b"), "da": F.col("a") - F.lag("a").over(w), "db": F.col("b") - F.lag("b").over(w)})


def backtest(index_monthly: DataFrame, reference_monthly: DataFrame, keys=(), least: int = 6, last: int | None = None) -> DataFrame:
    """One row (for each key): months, correlations, error, direction and a verdict. Under `least` common months the verdict says so."""
    pairs = align(index_monthly, reference_monthly, keys=keys)
    if last:
        nth = F.row_number().over(ordered(F.desc("period"), keys))
        pairs = pairs.withColumn("nth", nth).where(F.col("nth") <= last).drop("nth")
    table = rebased_pairs(pairs, keys=keys)
    a, b = F.col("a"), F.col("b")
    one = table.groupBy(*keys).agg(
        F.count("*").alias("months"),
        pearson(a, b).alias("pearson"),
        mape(a, b).alias("mape"),
        share_true(F.signum("da") == F.signum("db")).alias("directional"),
        F.coalesce(F.avg(F.abs(F.col("da") - F.col("db"))), F.lit(0.0)).alias("mean_mom_gap"),
    )
    ranks = spearman(pairs, keys)
    joined = one.join(ranks, list(keys)) if keys else one.crossJoin(F.broadcast(ranks))
    verdict = (
        F.when(F.col("months") < least, "insufficient overlap")
        .when((F.col("pearson") >= 0.9) & (F.col("mape") < 10), "PASS")
        .when(F.col("pearson") >= 0.7, "PASS (directional)")
        .otherwise("REVIEW")
    )
    return joined.withColumn("verdict", verdict)


def error_against(pairs: DataFrame, form: str = "rebased", on: str = "period", keys=()) -> DataFrame:
    """MAPE of x against y and the number of periods: of the values themselves (`level`, also for fares), or of both `rebased` to 100 at the first."""
    table = rebased_pairs(pairs, on, keys) if form == "rebased" else pairs.withColumns({"a": F.col("x"), "b": F.col("y")})
    return table.groupBy(*keys).agg(mape(F.col("a"), F.col("b")).alias("mape"), F.count("*").alias("periods"))


def backtest_table(index_monthly: DataFrame, reference_monthly: DataFrame, keys=()) -> DataFrame:
    return rebased_pairs(align(index_monthly, reference_monthly, keys=keys), keys=keys).orderBy(*keys, "period")


def ols(df: DataFrame, y: str, xs: list[str], by=()) -> DataFrame:
    """Least squares with an intercept: (by, term, beta, t, r2, n_rows).

    One aggregation forms the means and centred co-moments of each group. These
    merge pairwise, so they combine before the shuffle and stay exact where means
    are large; only these k x k numbers reach Python, where they are scaled. Of
    collinear columns the least-norm slopes are given. Groups with no more rows
    than terms get zeros.
    """
    names = [f"v{i}" for i in range(len(xs) + 1)]
    groups = [f"g{i}" for i in range(len(by))]
    full = df.dropna(subset=[*xs, y]).select(*[F.col(c).alias(g) for c, g in zip(by, groups)], *[F.col(c).cast("double").alias(v) for c, v in zip([*xs, y], names)])
    moments = [(F.covar_pop(a, b) * F.count("*")).alias(f"s_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    sums = full.groupBy(*groups).agg(F.count("*").alias("n_rows"), *[F.avg(v).alias(f"mean_{v}") for v in names], *moments).where("n_rows > 0")
    k = len(xs)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema)

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                s = np.array([[r[f"s_{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
                n, mean = int(r["n_rows"]), np.array([r[f"mean_v{i}"] for i in range(k)])
                beta, t, r2 = np.zeros(k + 1), np.zeros(k + 1), 0.0
                if n > k + 1:
                    scale = np.sqrt(np.where(np.diag(s)[:k] > 0, np.diag(s)[:k], 1.0))
                    inverse = np.linalg.pinv(s[:k, :k] / np.outer(scale, scale), rcond=1e-10, hermitian=True) / np.outer(scale, scale)
                    slopes = inverse @ s[:k, k]
                    rest = max(s[k, k] - slopes @ s[:k, k], 0.0)
                    variance = rest / (n - k - 1)
                    errors = np.sqrt(np.append(variance * (1 / n + mean @ inverse @ mean), variance * np.diag(inverse)))
                    beta = np.append(r[f"mean_v{k}"] - slopes @ mean, slopes)
                    t = np.divide(beta, errors, out=np.zeros(k + 1), where=errors > 0)
                    r2 = 1 - rest / s[k, k] if s[k, k] > 0 else 0.0
                rows += [{c: r[g] for c, g in zip(by, groups)} | {"term": c, "beta": beta[i], "t": t[i], "r2": r2, "n_rows": n} for i, c in enumerate(["intercept", *xs])]
            yield pd.DataFrame(rows, columns=[*by, "term", "beta", "t", "r2", "n_rows"])

    return sums.mapInPandas(solve, f"{fields}term string, beta double, t double, r2 double, n_rows long")


def driver_table(monthly: DataFrame, covariates: DataFrame, xs: list[str], on: str = "period", keys=(), last: int | None = None, plain=()) -> DataFrame:
    """Changes of the index (`y`) beside those of its covariates, in periods both have: log changes, of `plain` ones differences.

    Covariates are read once; `last` keeps the last so many changes that are whole.
    """
    w = ordered(on, keys)

    def change(x: str):
        before = F.lag(x).over(w)
        return F.col(x) - before if x in plain else F.when((F.col(x) > 0) & (before > 0), F.ln(F.col(x) / before))

    changed = log_changes(monthly, "value", on, keys).select(*keys, on, F.col("log_change").alias("y"))
    moved = covariates.select(*keys, on, *[change(x).alias(x) for x in xs])
    changed = changed.join(moved, [*keys, on])
    if last:
        nth = F.row_number().over(ordered(F.desc(on), keys))
        changed = changed.dropna(subset=["y", *xs]).withColumn("nth", nth).where(F.col("nth") <= last).drop("nth")
    return changed


def reading_of_day(daily: DataFrame, xs: list[str], day: int = 15, date: str = "date", keys=()) -> DataFrame:
    """(keys, period, xs): each month's reading of its `day`-th, or of the nearest earlier date of that month, else the first after."""
    late = F.dayofmonth(date) > day
    order = F.struct(late.cast("int"), F.when(late, F.dayofmonth(date)).otherwise(-F.dayofmonth(date)))
    return daily.groupBy(*keys, month_key(F.col(date)).alias("period")).agg(*[F.min_by(x, order).alias(x) for x in xs])


def shown_readings(covariates: DataFrame, xs: list[str], on: str = "period", keys=(), last: int = 18) -> DataFrame:
    """(keys, name, period, value): the last `last` readings of each covariate but the first of all, which has no change; for display, the fit uses every change."""
    w = ordered(F.desc(on), keys)
    numbered = covariates.withColumns({"nth": F.row_number().over(w), "left": F.count("*").over(W.partitionBy(*keys))})
    near = numbered.where((F.col("nth") <= last) & (F.col("nth") < F.col("left")))
    return near.select(*keys, F.explode(F.array(*[F.struct(F.lit(x).alias("name"), F.col(on).alias("period"), F.col(x).cast("double").alias("value")) for x in xs])).alias("r")).select(*keys, "r.*")


def driver_regression(monthly: DataFrame, covariates: DataFrame, xs: list[str], on: str = "period", keys=(), last: int | None = None, plain=()) -> DataFrame:
    """Coefficients (times 100) and t of the drivers of the index's log change, over every change; `last` limits the fit to the last ones."""
    fit = ols(driver_table(monthly, covariates, xs, on, keys, last, plain), "y", xs, keys)
    return fit.withColumn("effect", F.col("beta") * 100).withColumn("significant", F.abs("t") >= 2)


def significant_drivers(fit: DataFrame) -> DataFrame:
    return fit.where((F.abs("t") >= 2) & (F.col("term") != "intercept"))


def dominant_driver(fit: DataFrame) -> DataFrame:
    return fit.where("term <> 'intercept'").agg(F.max_by("term", F.abs("t")).alias("driver"), F.max(F.abs("t")).alias("t"))
