"""The build and the refresh of the panel, from landed files to the written table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.operators.clean import canonical
from tickloom.operators.panel import with_return
from tickloom.plans.refresh import build_panel, refresh
from tickloom.queries.data import BARS_SQL, bars
from tickloom.queries.panels import _canonical_sql
from tickloom.queries.registry import query
from tickloom.queries.sources import BARS_OUT
from tickloom.schema import PANEL_COLUMNS, PRICES
from tickloom.sources.landed import read_bar_files
from tickloom.sources.tables import read_panel, write_panel
from tickloom.staging import new_folder, stage


def land(rows: DataFrame, label: str) -> DataFrame:
    """Bars written as files of one source and read back."""
    folder = new_folder(rows.sparkSession, label)
    (rows.select(F.col("date").cast("string").alias("datetime"), *PRICES, "volume", F.col("stock").alias("symbol"))
     .write.csv(folder, header=True))
    return read_bar_files(rows.sparkSession, folder)


SILENT_SQL = BARS_SQL + """,
base AS (SELECT *, close / lag(close) OVER (PARTITION BY stock ORDER BY date) - 1 AS return_1d FROM bars
         WHERE date < DATE '2001-06-01'),
landed AS (SELECT stock, date, open, high, low,
                  close * CASE WHEN CAST(stock AS INTEGER) % 3 = 0 THEN 1.05 ELSE 1.02 END AS close, volume
           FROM bars WHERE date >= DATE '2001-01-01'),
overlap AS (SELECT * FROM landed WHERE date >= (SELECT max(date) FROM base) - 7),
returned AS (SELECT *, close / lag(close) OVER (PARTITION BY stock ORDER BY date) - 1 AS return_1d FROM overlap),
news AS (SELECT * FROM returned WHERE date > (SELECT max(date) FROM base) AND return_1d IS NOT NULL),
stored AS (SELECT * FROM base UNION ALL SELECT * FROM news)
"""


@query("refreshed_panel", SILENT_SQL + _canonical_sql("stored"))
def refreshed_panel(spark: SparkSession, sf: str) -> DataFrame:
    """A stored panel after a refresh and its replay: the first source is silent on every third stock, and both
    sources also have stocks that the panel doesn't know."""
    b = stage(bars(spark, sf), "bars")
    path = new_folder(spark, "panel")
    base = with_return(b.filter(F.col("date") < F.lit("2001-06-01").cast("date")), ["stock"])
    write_panel(canonical(base.select(PANEL_COLUMNS)), path)
    late = b.filter(F.col("date") >= F.lit("2001-01-01").cast("date")).select(BARS_OUT)
    late = late.unionByName(late.withColumn("stock", F.concat(F.lit("new"), "stock")))
    silent = F.col("stock").try_cast("int") % 3 == 0
    primary = land(late.filter(~F.coalesce(silent, F.lit(False))).withColumn("close", F.col("close") * 1.02), "primary")
    fallback = land(late.withColumn("close", F.col("close") * 1.05), "fallback")
    for _ in range(2):
        refresh(spark, path, primary, fallback)
    return read_panel(spark, path).select(PANEL_COLUMNS)


LISTED_SQL = BARS_SQL + """,
listed AS (SELECT stock FROM bars GROUP BY stock HAVING CAST(stock AS INTEGER) % 5 <> 0),
older AS (SELECT *, close / lag(close) OVER (PARTITION BY stock ORDER BY date) - 1 AS return_1d FROM bars SEMI JOIN listed USING (stock)),
shifted AS (SELECT stock, date, open, high, low, close * 1.01 AS close, volume FROM bars SEMI JOIN listed USING (stock)
            WHERE date >= DATE '1997-07-01'),
newer AS (SELECT *, close / lag(close) OVER (PARTITION BY stock ORDER BY date) - 1 AS return_1d FROM shifted),
stacked AS (SELECT 0 AS priority, * FROM older WHERE date < DATE '1998-01-01' UNION ALL SELECT 1, * FROM newer),
single AS (SELECT * FROM stacked QUALIFY row_number() OVER (PARTITION BY stock, date ORDER BY priority) = 1),
kept AS (SELECT * FROM single WHERE return_1d IS NOT NULL QUALIFY count(*) OVER (PARTITION BY stock) >= 540)
"""


def _built(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    b = stage(bars(spark, sf), "bars")
    names = b.filter(F.col("stock").cast("int") % 5 != 0).select(F.col("stock").alias("clean_symbol")).unionByName(
        spark.range(1).select(F.lit("unlanded").alias("clean_symbol")))
    path = new_folder(spark, "built")
    newer = b.filter(F.col("date") >= F.lit("1997-07-01").cast("date")).withColumn("close", F.col("close") * 1.01)
    skipped = build_panel(spark, names, land(b, "older"), land(newer, "newer"), path, date(1998, 1, 1), 540)
    return path, skipped


@query("built_panel", LISTED_SQL + _canonical_sql("kept"))
def built_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The panel of the listed stocks, from two folders of files to the table."""
    return read_panel(spark, _built(spark, sf)[0]).select(PANEL_COLUMNS)


@query("build_skipped", LISTED_SQL + """
SELECT stock FROM (SELECT stock FROM listed UNION ALL SELECT 'unlanded') ANTI JOIN kept USING (stock)""")
def build_skipped(spark: SparkSession, sf: str) -> DataFrame:
    """Listed stocks that the build left out."""
    return _built(spark, sf)[1]
