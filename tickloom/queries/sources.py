"""Scans, landed files and sinks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.operators.clean import exchange_ticker, listed_instruments
from tickloom.operators.asof import asof_join
from tickloom.operators.panel import to_wide
from tickloom.queries.data import (BARS_SQL, BRAND_PANEL_SQL, PANEL_SQL, bars, brand_panel, panel,
                                   table, ticks)
from tickloom.plans.refresh import ingest
from tickloom.queries.registry import query, rounded
from tickloom.schema import PRICES
from tickloom.sources.bystock import read_by_stock, write_by_stock
from tickloom.sources.landed import (as_long_returns, landed_files, not_ingested, read_bar_files,
                                     read_dirty_bar_files, read_instruments)
from tickloom.sources.tables import (latest_snapshot, read_panel, scan, stock_history, write_panel,
                                     write_snapshot)
from tickloom.sources.wide import matrix_rows, read_wide_files, stock_numbers, write_wide_files
from tickloom.staging import many_files, new_folder, stage

PARTITION_VALUE = r"stock=([^/]+)/"


def instruments(spark: SparkSession, sf: str) -> DataFrame:
    """An instrument master made from the parts: two exchanges, two kinds, two suffixes."""
    code = F.upper(F.replace("p_name", F.lit(" "), F.lit("-EQ")))
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("token"),
        F.concat(code, F.when(F.col("p_size") % 2 == 1, "-EQ").otherwise("-BE")).alias("symbol"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_brand").startswith("Brand#1"), "NSE").otherwise("BSE").alias("exch_seg"),
        F.when(F.col("p_type") == "SMALL", "FUT").otherwise("").alias("instrumenttype"))


INSTRUMENTS_SQL = """
WITH instruments AS (
  SELECT CAST(p_partkey AS VARCHAR) AS token,
         upper(replace(p_name, ' ', '-EQ')) || CASE WHEN p_size % 2 = 1 THEN '-EQ' ELSE '-BE' END AS symbol,
         p_name AS name, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'NSE' ELSE 'BSE' END AS exch_seg,
         CASE WHEN p_type = 'SMALL' THEN 'FUT' ELSE '' END AS instrumenttype
  FROM part)
"""


@query("instrument_master_scan", INSTRUMENTS_SQL + "SELECT * FROM instruments")
def instrument_master_scan(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "instruments")
    instruments(spark, sf).write.json(folder)
    return read_instruments(spark, folder, multi_line=False)


@query("listed_instruments", INSTRUMENTS_SQL + """
SELECT token, symbol, name, exch_seg, replace(symbol, '-EQ', '') AS clean_symbol,
       replace(symbol, '-EQ', '') || '.NS' AS ticker
FROM instruments WHERE exch_seg = 'NSE' AND instrumenttype = '' AND symbol LIKE '%-EQ'""")
def listed(spark: SparkSession, sf: str) -> DataFrame:
    return exchange_ticker(listed_instruments(instruments(spark, sf)), "clean_symbol")


BARS_OUT = ["date", "stock", *PRICES, "volume"]


@query("landed_bar_files", BARS_SQL + f"SELECT {', '.join(BARS_OUT)} FROM bars")
def landed_bar_files(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "landed")
    (bars(spark, sf).select(F.col("date").cast("string").alias("datetime"), *PRICES, "volume",
                            F.col("stock").alias("symbol"))
     .write.csv(folder, header=True))
    return read_bar_files(spark, folder)


# Five ranges of a supplier's balance stand for five kinds of file; the last lacks a column.
KIND_SQL = """
kinds AS (SELECT CAST(s_suppkey AS VARCHAR) AS stock, CASE WHEN s_acctbal < 1000 THEN 0 WHEN s_acctbal < 3000 THEN 1
          WHEN s_acctbal < 5000 THEN 2 WHEN s_acctbal < 8000 THEN 3 ELSE 4 END AS kind FROM supplier)
"""


def file_kinds(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("s_acctbal")
    kind = F.when(b < 1000, 0).when(b < 3000, 1).when(b < 5000, 2).when(b < 8000, 3).otherwise(4)
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("stock"), kind.alias("kind"))


@query("landed_dirty_bar_files", BARS_SQL + "," + KIND_SQL + """
SELECT date, stock, open, high, low, close, volume FROM bars JOIN kinds USING (stock) WHERE kind <> 4""")
def landed_dirty_bar_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files with five kinds of header, junk rows and, in the last kind, no volume column."""
    kind = F.col("kind")
    text = {c: F.col(c).cast("string") for c in [*PRICES, "volume"]}
    line = (F.when(kind == 3, F.concat_ws(",", F.col("date"), text["volume"], text["close"],
                                          F.lit("-1"), text["low"], text["high"], text["open"]))
            .when(kind == 4, F.concat_ws(",", F.col("date"), *[text[c] for c in PRICES]))
            .otherwise(F.concat_ws(",", F.col("date"), *[text[c] for c in [*PRICES, "volume"]])))
    header = (F.when(kind == 1, "Date, open ,HIGH,Low,Close ,Volume")
              .when(kind == 2, "date,Open,High,Low,Adj Close,Volume")
              .when(kind == 3, "Price,Volume,Close,Adj Close,Low,High,Open")
              .when(kind == 4, "Date,Open,High,Low,Close")
              .otherwise("Date,Open,High,Low,Close,Volume"))
    junk = F.concat(F.lit("Ticker"), F.repeat(F.concat(F.lit(","), F.col("stock"), F.lit(".NS")), 5))
    kinds = file_kinds(spark, sf)
    heads = kinds.select("stock", F.posexplode(F.array(header, junk, F.lit("Date,,,,,"))).alias("at", "value"))
    rows = bars(spark, sf).join(kinds, "stock").select("stock", F.lit(9).alias("at"), line.alias("value"))
    folder = new_folder(spark, "dirty")
    (heads.unionByName(rows).repartition("stock").sortWithinPartitions("stock", "at", "value")
     .select("stock", "value").write.partitionBy("stock").options(**many_files(spark, folder)).text(folder))
    return read_dirty_bar_files(spark, folder, PARTITION_VALUE)


BRANDS = [f"Brand#{i}" for i in range(1, 26)]          # every brand of the part table


@query("either_return_layout", BRAND_PANEL_SQL + """
SELECT date, stock, round(return_1d, 6) + 0.0 AS return_1d FROM panel WHERE return_1d IS NOT NULL
UNION ALL
SELECT date, stock || 'L', round(return_1d, 6) + 0.0 FROM panel WHERE return_1d IS NOT NULL""")
def either_return_layout(spark: SparkSession, sf: str) -> DataFrame:
    p = stage(brand_panel(spark, sf).filter(F.col("return_1d").isNotNull()), "panel")
    wide = as_long_returns(to_wide(p, BRANDS))
    long = as_long_returns(p.withColumn("stock", F.concat("stock", F.lit("L"))))
    return rounded(wide.unionByName(long), "return_1d")


@query("pruned_scan", "SELECT l_suppkey, l_quantity, l_extendedprice FROM lineitem")
def pruned_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan(spark, f"{sf}/lineitem.parquet", ["l_suppkey", "l_quantity", "l_extendedprice"])


@query("stock_history", PANEL_SQL + """
SELECT date, stock, close, round(return_1d, 6) + 0.0 AS return_1d FROM panel WHERE stock = '7'""")
def one_stock_history(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "history")
    write_panel(panel(spark, sf), folder)
    got = stock_history(read_panel(spark, folder), "7")
    return rounded(got.select("date", "stock", "close", "return_1d"), "return_1d")


@query("bucketed_history", PANEL_SQL + """
SELECT date, stock, close, round(return_1d, 6) + 0.0 AS return_1d FROM panel WHERE stock = '7'""")
def one_bucket_history(spark: SparkSession, sf: str) -> DataFrame:
    """The same from the panel clustered by stock: one bucket is read."""
    folder = new_folder(spark, "by-stock")
    write_by_stock(panel(spark, sf), folder, buckets=16)
    got = stock_history(read_by_stock(spark, folder), "7")
    return rounded(got.select("date", "stock", "close", "return_1d"), "return_1d")


@query("wide_return_files", PANEL_SQL + """
SELECT date, stock, round(return_1d, 6) + 0.0 AS return_1d FROM panel WHERE return_1d IS NOT NULL""")
def wide_return_files(spark: SparkSession, sf: str) -> DataFrame:
    """All returns written as files with a column a stock, and read back by their headers."""
    p = stage(panel(spark, sf).filter(F.col("return_1d").isNotNull()), "panel")
    numbers, folder = stage(stock_numbers(p), "numbers"), new_folder(spark, "wide")
    write_wide_files(matrix_rows(p, numbers), numbers, folder, files=3)
    return rounded(read_wide_files(spark, folder), "return_1d")


@query("return_matrix", PANEL_SQL + """,
numbers AS (SELECT stock, row_number() OVER (ORDER BY stock) - 1 AS no FROM (SELECT DISTINCT stock FROM panel)),
cells AS (SELECT date, no, return_1d AS r FROM panel JOIN numbers USING (stock) WHERE return_1d IS NOT NULL)
SELECT date, (SELECT count(*) FROM numbers)::INTEGER AS n_cells, count(*)::INTEGER AS n_known, min(no)::INTEGER AS first_known,
       max(no)::INTEGER AS last_known, round(sum(r), 6) + 0.0 AS total, round(sum(r * no), 6) + 0.0 AS weighted
FROM cells GROUP BY date""")
def return_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """One row a date with an array of all stocks' returns, and what its places hold."""
    p = stage(panel(spark, sf), "panel")
    rows = matrix_rows(p, stage(stock_numbers(p), "numbers")).withColumn("n_cells", F.size("values"))
    cells = rows.select("date", "n_cells", F.posexplode("values").alias("no", "r")).filter(F.col("r").isNotNull())
    return rounded(cells.groupBy("date", "n_cells").agg(
        F.count("*").cast("int").alias("n_known"), F.min("no").alias("first_known"), F.max("no").alias("last_known"),
        F.sum("r").alias("total"), F.sum(F.col("r") * F.col("no")).alias("weighted")), "total", "weighted")


def _asof_sql(sign: str) -> str:
    return BARS_SQL + f"""
SELECT t.l_orderkey, t.l_linenumber, t.l_partkey, t.price, t.stock, t.date, b.date AS bar_date, b.close AS bar_close
FROM (SELECT CAST(l_suppkey AS VARCHAR) AS stock, CAST(l_shipdate AS DATE) AS date, 1000 + l_extendedprice / 1000 AS price,
             l_orderkey, l_linenumber, l_partkey FROM lineitem) t
ASOF LEFT JOIN bars b ON t.stock = b.stock AND t.date {sign} b.date"""


def _asof(spark: SparkSession, sf: str, strict: bool) -> DataFrame:
    t = ticks(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "price", "stock", "date")
    b = bars(spark, sf).select("stock", F.col("date").alias("bar_date"), F.col("close").alias("bar_close"))
    return asof_join(t, b, "stock", "date", strict, "bar_date")


@query("ticks_after_bars", _asof_sql(">"))
def ticks_after_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Every trade beside its stock's last bar of an earlier day."""
    return _asof(spark, sf, strict=True)


@query("ticks_at_bars", _asof_sql(">="))
def ticks_at_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Every trade beside its stock's last bar, that of its own day included."""
    return _asof(spark, sf, strict=False)


@query("panel_table", PANEL_SQL + """
SELECT date, stock, open, high, low, close, volume, round(return_1d, 6) + 0.0 AS return_1d
FROM panel
WHERE date >= DATE '1997-03-15' AND date < DATE '2001-02-10'""")
def panel_table(spark: SparkSession, sf: str) -> DataFrame:
    folder = new_folder(spark, "table")
    write_panel(panel(spark, sf), folder)
    span = read_panel(spark, folder, since=date(1997, 3, 15), before=date(2001, 2, 10))
    return rounded(span, "return_1d").select(*BARS_OUT, "return_1d")


@query("dated_snapshots", BARS_SQL + """
SELECT stock, count(*) AS n_bars, max(date) AS last_date, DATE '2001-02-01' AS as_of
FROM bars GROUP BY stock""")
def dated_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Two days are written, the later one twice; the latest day is read back."""
    folder = new_folder(spark, "snapshots")
    now = bars(spark, sf).groupBy("stock").agg(F.count("*").alias("n_bars"), F.max("date").alias("last_date"))
    for day, rows in (("2001-01-31", now), ("2001-02-01", now.withColumn("n_bars", F.lit(0).cast("bigint"))),
                      ("2001-02-01", now)):
        write_snapshot(rows, folder, F.to_date(F.lit(day)))
    return latest_snapshot(spark, folder)


@query("ledger_ingest", BARS_SQL + f"""
SELECT {', '.join(BARS_OUT)} FROM bars""")
def ledger_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Files land in two waves and are taken in three runs; no file is lost or taken twice."""
    landing, path = new_folder(spark, "waves"), new_folder(spark, "ingested")
    rows = stage(bars(spark, sf).select(F.col("date").cast("string").alias("datetime"), *PRICES, "volume",
                                        F.col("stock").alias("symbol")), "rows")
    early = F.col("datetime") < "1998-01-01"
    rows.filter(early).write.csv(f"{landing}/wave=1", header=True)
    ingest(spark, path, landing)
    rows.filter(~early).write.csv(f"{landing}/wave=2", header=True)
    ingest(spark, path, landing, most=2)
    ingest(spark, path, landing)
    return read_panel(spark, path).select(BARS_OUT)


@query("resume_ingest", BARS_SQL + "," + KIND_SQL + """
SELECT stock FROM bars JOIN kinds USING (stock) WHERE kind <> 3
GROUP BY stock HAVING max(date) >= DATE '2001-06-01'""")
def resume_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Instruments whose landed file the ledger does not know yet."""
    folder = new_folder(spark, "arrivals")
    (bars(spark, sf).groupBy("stock").agg(F.max("date").alias("last"))
     .filter(F.col("last") >= F.to_date(F.lit("2001-06-01")))
     .select("stock", F.col("last").cast("string").alias("value"))
     .write.partitionBy("stock").text(folder))
    files = landed_files(spark, folder).withColumn(
        "stock", F.regexp_extract("path", PARTITION_VALUE, 1))
    ledger = files.join(file_kinds(spark, sf).filter(F.col("kind") == 3), "stock", "left_semi").select("path")
    return not_ingested(files, ledger).select("stock")
