"""Cross-sectional regressions per period and their summaries over periods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.scalar import half_even, p_wording, t_marks, two_sided_p


def period_regression(df: DataFrame, x: str = "score", y: str = "realised", by: str = "period",
                      min_common: int = 20, min_complete: int = 10) -> DataFrame:
    """Slope and r-squared of y on x per period, from moments combined on the map side.

    Where y is the same everywhere nothing is explained, so r-squared is 0.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    flat = F.min(F.when(both, F.col(y))) == F.max(F.when(both, F.col(y)))
    return (df.groupBy(by).agg(F.count("*").alias("n_common"), F.count_if(both).alias("n"),
                               F.regr_slope(y, x).alias("slope"), F.when(flat, 0.0).otherwise(F.regr_r2(y, x)).alias("r2"))
            .filter((F.col("n_common") >= min_common) & (F.col("n") >= min_complete)))


def fama_macbeth(per_period: DataFrame, rounded: bool = True) -> DataFrame:
    """One row: mean slope, its t statistic and p value, mean r-squared, number of periods."""
    m = per_period.agg(F.avg("slope").alias("mean_coef"), F.stddev_samp("slope").alias("sd"),
                       F.avg("r2").alias("mean_r2"), F.count("slope").alias("n_periods"))
    t = F.try_divide(F.col("mean_coef"), F.col("sd") / F.sqrt("n_periods"))
    m = (m.withColumn("t_stat", t)
         .withColumn("p_value", two_sided_p(F.col("t_stat"), F.col("n_periods") - 1))
         .withColumn("verdict", p_wording(F.col("p_value"))))

    def r(c: str, places: int) -> Column:
        return (half_even(F.col(c), places) if rounded else F.col(c)).alias(c)
    return m.select(r("mean_coef", 6), r("t_stat", 3), r("p_value", 4), r("mean_r2", 4),
                    F.col("n_periods").cast("int").alias("n_periods"), "verdict")


def _slopes(cov: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Least squares from centred moments; the shortest solution where columns are collinear."""
    sd = np.sqrt(np.diag(cov))
    if (sd > 0).all():
        corr = cov / np.outer(sd, sd)
        if np.linalg.eigvalsh(corr)[0] > 1e-10:
            return np.linalg.solve(corr, cross / sd) / sd
    return np.linalg.pinv(cov, rcond=1e-12, hermitian=True) @ cross


def period_factor_regression(df: DataFrame, xs: list[str], y: str = "realised", by: str = "period",
                             min_common: int = 30, min_complete: int = 20) -> DataFrame:
    """Coefficients of y on several columns and an intercept, one row per period.

    Spark reduces each period to its means and covariances; only those few numbers per period
    reach Python, where the small system is solved.
    """
    complete = F.lit(True)
    for c in [*xs, y]:
        complete = complete & F.col(c).isNotNull()
    v = {c: F.when(complete, F.col(c)) for c in [*xs, y]}
    names = [*xs, y]
    moments = [F.avg(v[c]).alias(f"m{i}") for i, c in enumerate(names)]
    moments += [F.covar_pop(v[names[i]], v[names[j]]).alias(f"c{i}_{j}")
                for i in range(len(names)) for j in range(i, len(names))]
    per = (df.groupBy(by).agg(F.count("*").alias("n_common"), F.count_if(complete).alias("n"), *moments)
           .filter((F.col("n_common") >= min_common) & (F.col("n") >= min_complete)))
    k = len(xs)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                cross = np.array([r[f"c{i}_{k}"] for i in range(k)])
                b = _slopes(cov, cross)
                level = r[f"m{k}"] - sum(b[i] * r[f"m{i}"] for i in range(k))
                out.append([r[by], int(r["n"]), level, *b])
            yield pd.DataFrame(out, columns=[by, "n", "intercept", *xs])

    kind = df.schema[by].dataType.simpleString()
    cols = ", ".join(f"`{c}` double" for c in ["intercept", *xs])
    return per.mapInPandas(solve, f"`{by}` {kind}, n int, {cols}")


def coefficient_summary(coefs: DataFrame, names: list[str]) -> DataFrame:
    """Per coefficient: mean over periods, t (0 without spread) and its significance mark."""
    long = coefs.unpivot([], names, "name", "coef").filter(F.col("coef").isNotNull())
    s = long.groupBy("name").agg(F.avg("coef").alias("mean_coef"), F.stddev_pop("coef").alias("spread"),
                                 F.stddev_samp("coef").alias("sd"), F.count("*").alias("n_periods"))
    t = F.when(F.col("spread") > 0, F.try_divide(
        F.col("mean_coef"), F.col("sd") / F.sqrt("n_periods"))).otherwise(0.0)
    return (s.withColumn("t_stat", t).withColumn("mark", t_marks(F.col("t_stat")))
            .select("name", "mean_coef", "t_stat", "mark", "n_periods"))
