"""Walk-forward evaluation."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession

from tickloom.operators.performance import performance
from tickloom.operators.ranks import legs
from tickloom.operators.regress import (coefficient_summary, fama_macbeth, period_factor_regression,
                                        period_regression)
from tickloom.plans.backtest import (FACTORS, factor_table, leg_series, portfolio_returns,
                                     scored_periods, staged_calendar, walk_forward_scores,
                                     with_realised)
from tickloom.queries.data import (LEGS_SQL, PANEL_SQL, PERIODS_SQL, REALISED_SQL, RESULTS_SQL, SERIES_SQL,
                                   START, WALK_SQL, panel, staged_panel)
from tickloom.queries.registry import query, rounded
from tickloom.staging import stage


class Walk:
    """The shared inputs of an evaluation: panel table, periods, calendar, scores."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.panel = staged_panel(spark, sf)
        self.calendar, self.periods, self.days = staged_calendar(self.panel, START)
        self.scores = walk_forward_scores(self.panel, self.periods, self.days)

    def results(self, **options) -> DataFrame:
        return portfolio_returns(self.scores, self.panel, self.days, self.periods, **options)

    def scored(self) -> DataFrame:
        return with_realised(self.scores, self.panel, self.days)


@query("scored_periods", PANEL_SQL + PERIODS_SQL + """
SELECT period, reb_date, next_date, count(*) AS n_days, CAST(least(count(*), 5) AS INTEGER) AS horizon
FROM periods JOIN days ON held_in = period WHERE next_date IS NOT NULL GROUP BY ALL""")
def periods_with_horizon(spark: SparkSession, sf: str) -> DataFrame:
    _, periods, days = staged_calendar(panel(spark, sf), START)
    return scored_periods(days, periods, 5)


@query("walk_forward_scores", WALK_SQL + """
SELECT period, stock, token, round(score, 6) + 0.0 AS score FROM scores""")
def scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Walk(spark, sf).scores, "score")


@query("portfolio_legs", WALK_SQL + LEGS_SQL + "SELECT period, stock, leg FROM legs")
def portfolio_legs(spark: SparkSession, sf: str) -> DataFrame:
    return legs(Walk(spark, sf).scores).select("period", "stock", "leg")


@query("backtest_results", WALK_SQL + RESULTS_SQL + """
SELECT date, round(long_ret, 6) + 0.0 AS long_ret, round(short_ret, 6) + 0.0 AS short_ret,
       round(ls_ret, 6) + 0.0 AS ls_ret FROM results""")
def results(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Walk(spark, sf).results(), "long_ret", "short_ret", "ls_ret")


@query("backtest_results_compounded", WALK_SQL + RESULTS_SQL + """,
grown AS (SELECT period, leg, exp(sum(ln(1 + r))) - 1 AS ret FROM leg_days GROUP BY ALL)
SELECT o.reb_date AS date, round(max(CASE WHEN leg = 'long' THEN ret END), 6) + 0.0 AS long_ret,
       round(max(CASE WHEN leg = 'short' THEN ret END), 6) + 0.0 AS short_ret,
       round(max(CASE WHEN leg = 'long' THEN ret END) - max(CASE WHEN leg = 'short' THEN ret END) - 0.002, 6) + 0.0 AS ls_ret
FROM (SELECT DISTINCT period FROM scores) JOIN open_periods o USING (period) LEFT JOIN grown USING (period)
GROUP BY o.reb_date""")
def compounded(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Walk(spark, sf).results(holding="compound", cost_model="spread"),
                   "long_ret", "short_ret", "ls_ret")


@query("backtest_summary", WALK_SQL + RESULTS_SQL + SERIES_SQL + """,
known AS (SELECT * FROM series WHERE ret IS NOT NULL),
curve AS (SELECT *, product(1 + ret) OVER (PARTITION BY label ORDER BY date ROWS UNBOUNDED PRECEDING) AS growth FROM known),
peaked AS (SELECT *, max(growth) OVER (PARTITION BY label ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM curve)
SELECT label, round((pow(product(1 + ret), 12.0 / count(*)) - 1) * 100, 6) + 0.0 AS cagr_pct,
       round(CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(12) ELSE 0 END, 6) + 0.0 AS sharpe,
       round(min((growth - peak) / peak) * 100, 6) + 0.0 AS max_dd_pct,
       round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) + 0.0 AS win_rate_pct,
       round((product(1 + ret) - 1) * 100, 6) + 0.0 AS total_ret_pct, CAST(count(*) AS INTEGER) AS n_periods
FROM peaked GROUP BY label""")
def summary(spark: SparkSession, sf: str) -> DataFrame:
    s = performance(leg_series(Walk(spark, sf).results()), rounded=False)
    return rounded(s, *[c for c in s.columns if c not in ("label", "n_periods")])


SLOPES_SQL = """,
slopes AS (
  SELECT period, count(*) AS n_common, count(*) AS n, regr_slope(realised, score) AS slope,
         CASE WHEN min(realised) FILTER (score IS NOT NULL) = max(realised) FILTER (score IS NOT NULL) THEN 0.0::DOUBLE ELSE regr_r2(realised, score) END AS r2
  FROM scored GROUP BY period HAVING count(*) >= 20)
"""


@query("period_regressions", WALK_SQL + REALISED_SQL + SLOPES_SQL + """
SELECT period, n_common, n, round(slope, 6) + 0.0 AS slope, round(r2, 6) + 0.0 AS r2 FROM slopes""")
def period_slopes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(period_regression(Walk(spark, sf).scored()), "slope", "r2")


@query("fama_macbeth", WALK_SQL + REALISED_SQL + SLOPES_SQL + """
SELECT round(avg(slope), 6) + 0.0 AS mean_coef,
       round(avg(slope) / (stddev_samp(slope) / sqrt(count(slope))), 6) + 0.0 AS t_stat,
       round(avg(r2), 6) + 0.0 AS mean_r2, CAST(count(slope) AS INTEGER) AS n_periods FROM slopes""")
def fm(spark: SparkSession, sf: str) -> DataFrame:
    got = fama_macbeth(period_regression(Walk(spark, sf).scored()), rounded=False)
    return rounded(got.select("mean_coef", "t_stat", "mean_r2", "n_periods"), "mean_coef", "t_stat", "mean_r2")


# The two-sided tail of Student's t for whole degrees of freedom v, with gamma functions for the
# coefficients of the cosine series.
VERDICT_SQL = WALK_SQL + REALISED_SQL + SLOPES_SQL + """,
m AS (SELECT avg(slope) AS b, avg(slope) / (stddev_samp(slope) / sqrt(count(slope))) AS t, avg(r2) AS r2,
             CAST(count(slope) AS INTEGER) AS n, CAST(count(slope) - 1 AS INTEGER) AS v FROM slopes),
angle AS (SELECT *, atan(abs(t) / sqrt(v)) AS a FROM m),
series AS (
  SELECT any_value(v) AS v, any_value(a) AS a, sum(pow(cos(a), 2 * j) * CASE WHEN v % 2 = 0
           THEN exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi())
           ELSE exp(lgamma(j + 1) - lgamma(j + 1.5)) * sqrt(pi()) / 2 END) AS total
  FROM angle, (SELECT unnest(generate_series(0, 2000)) AS j) WHERE j < v // 2),
p AS (SELECT CASE WHEN a IS NOT NULL THEN greatest(0, 1 - CASE WHEN v % 2 = 0 THEN sin(a) * total
                ELSE 2 / pi() * (a + sin(a) * cos(a) * coalesce(total, 0)) END) END AS p FROM series)
SELECT round_even(b * 1e6, 0) / 1e6 + 0.0 AS mean_coef, round_even(t * 1e3, 0) / 1e3 + 0.0 AS t_stat,
       round_even(p * 1e4, 0) / 1e4 + 0.0 AS p_value, round_even(r2 * 1e4, 0) / 1e4 + 0.0 AS mean_r2,
       n AS n_periods, CASE WHEN p < 0.001 THEN 'p<0.001' WHEN p < 0.01 THEN 'p<0.01'
       WHEN p < 0.05 THEN 'p<0.05' ELSE 'not significant' END AS verdict FROM m, p"""


@query("fama_macbeth_verdict", VERDICT_SQL)
def fm_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return fama_macbeth(period_regression(Walk(spark, sf).scored()))


def _determinant(cells: list[list[str]]) -> str:
    """A determinant written out as the signed products of all permutations."""
    terms = []
    for p in permutations(range(len(cells))):
        sign = sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p))) % 2
        terms.append(("-" if sign else "+") + " * ".join(cells[i][c] for i, c in enumerate(p)))
    return " ".join(terms)


def _factor_sql(factors_sql: str) -> str:
    """Four slopes per period by Cramer's rule on the correlations."""
    k = len(FACTORS)
    names = [*FACTORS, "realised"]
    r = {(i, j): f"r{min(i, j)}{max(i, j)}" for i in range(k + 1) for j in range(k + 1)}
    pairs = ", ".join(f"corr({names[i]}, {names[j]}) AS r{i}{j}" for i in range(k + 1) for j in range(i, k + 1))
    spread = ", ".join(f"stddev_pop({c}) AS sd{i}" for i, c in enumerate(names))
    square = [[r[i, j] for j in range(k)] for i in range(k)]
    slopes = []
    for x in range(k):
        swapped = [[r[i, k] if j == x else square[i][j] for j in range(k)] for i in range(k)]
        slopes.append(f"({_determinant(swapped)}) / ({_determinant(square)}) * sd{k} / sd{x} AS {FACTORS[x]}")
    return (WALK_SQL + REALISED_SQL + factors_sql + f""",
moments AS (SELECT period, count(*) AS n, {pairs}, {spread} FROM observed
            WHERE volatility IS NOT NULL GROUP BY period HAVING count(*) >= 30),
coefs AS (SELECT period, CAST(n AS INTEGER) AS n, {', '.join(slopes)} FROM moments)
""")


AT_REBALANCE_SQL = """,
calendar AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM panel)),
aged AS (SELECT k.period, p.stock, p.return_1d, r.pos - c.pos AS age
         FROM periods k JOIN calendar r ON r.date = k.reb_date
         JOIN calendar c ON c.pos > r.pos - 20 AND c.pos <= r.pos JOIN panel p ON p.date = c.date),
factors AS (SELECT period, stock, coalesce(sum(return_1d), 0) AS momentum,
                   -coalesce(sum(CASE WHEN age < 5 THEN return_1d END), 0) AS reversal,
                   stddev_samp(return_1d) AS volatility FROM aged GROUP BY ALL),
observed AS (SELECT s.*, coalesce(momentum, 0) AS momentum, coalesce(reversal, 0) AS reversal, volatility
             FROM scored s LEFT JOIN factors f USING (period, stock))
"""

AT_END_SQL = """,
calendar AS (SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM panel)),
factors AS (
  SELECT stock, coalesce(sum(CASE WHEN age < 20 THEN return_1d END), 0) AS momentum,
         -coalesce(sum(CASE WHEN age < 5 THEN return_1d END), 0) AS reversal,
         stddev_samp(CASE WHEN age < 20 THEN return_1d END) AS volatility
  FROM (SELECT p.*, (SELECT max(pos) FROM calendar) - pos AS age FROM panel p JOIN calendar USING (date))
  GROUP BY stock),
observed AS (SELECT s.*, momentum, reversal, volatility FROM scored s JOIN factors f USING (stock))
"""


@query("factor_coefficients", _factor_sql(AT_REBALANCE_SQL) + """
SELECT period, n, round(score, 6) + 0.0 AS score, round(momentum, 6) + 0.0 AS momentum,
       round(reversal, 6) + 0.0 AS reversal, round(volatility, 6) + 0.0 AS volatility FROM coefs""")
def factor_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    """Four slopes per period; factors as known at each rebalance date."""
    w = Walk(spark, sf)
    coefs = period_factor_regression(factor_table(w.scored(), w.panel, w.calendar, w.periods, "rebalance"), FACTORS)
    return rounded(coefs.drop("intercept"), *FACTORS)


@query("factor_summary", _factor_sql(AT_END_SQL) + """,
long AS (UNPIVOT coefs ON score, momentum, reversal, volatility INTO NAME name VALUE coef),
s AS (SELECT name, avg(coef) AS b, avg(coef) / (stddev_samp(coef) / sqrt(count(*))) AS t, count(*) AS n
      FROM long GROUP BY name)
SELECT name, round(b, 6) + 0.0 AS mean_coef, round(t, 6) + 0.0 AS t_stat, n AS n_periods,
       CASE WHEN abs(t) > 2.58 THEN 'p<0.01' WHEN abs(t) > 1.96 THEN 'p<0.05' WHEN abs(t) > 1.65 THEN 'p<0.10' ELSE '' END AS mark
FROM s""")
def factor_summary(spark: SparkSession, sf: str) -> DataFrame:
    w = Walk(spark, sf)
    coefs = stage(period_factor_regression(factor_table(w.scored(), w.panel, w.calendar, w.periods), FACTORS), "coefs")
    return rounded(coefficient_summary(coefs, FACTORS), "mean_coef", "t_stat")


@query("coefficient_summary", WALK_SQL + REALISED_SQL + SLOPES_SQL + """,
long AS (SELECT 'slope' AS name, slope AS coef FROM slopes UNION ALL SELECT 'r2', r2 FROM slopes),
s AS (SELECT name, avg(coef) AS mean_coef, CASE WHEN stddev_pop(coef) > 0
             THEN avg(coef) / (stddev_samp(coef) / sqrt(count(*))) ELSE 0 END AS t, count(*) AS n FROM long GROUP BY name)
SELECT name, round(mean_coef, 6) + 0.0 AS mean_coef, round(t, 6) + 0.0 AS t_stat,
       CASE WHEN abs(t) > 2.58 THEN 'p<0.01' WHEN abs(t) > 1.96 THEN 'p<0.05' WHEN abs(t) > 1.65 THEN 'p<0.10' ELSE '' END AS mark,
       n AS n_periods FROM s""")
def slope_summary(spark: SparkSession, sf: str) -> DataFrame:
    per = period_regression(Walk(spark, sf).scored()).select("slope", "r2")
    return rounded(coefficient_summary(per, ["slope", "r2"]), "mean_coef", "t_stat")
