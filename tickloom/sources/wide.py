"""Wide tables of thousands of stocks: files with a column a stock, and matrix rows, without Spark columns.

A plan with 20,000 columns takes minutes to compile. A line of a wide file is kept as an array instead and dealt out by
the places in its file's header; a date of the matrix is one row with an array of values by the number of the stock.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tickloom.functions.scalar import null_if_nan
from tickloom.sources.landed import cells_of
from tickloom.staging import stage

STOCKS = 1 << 14                                # for each of which a part of a wide table has one file more
DATE_NAMES = ("date", "datetime", "")           # what the first cell of a header may say


def stock_numbers(df: DataFrame) -> DataFrame:
    """(stock, no): the stocks in order, from 0. One row a stock, so one task orders them."""
    return df.select("stock").distinct().filter(F.col("stock").isNotNull()).select(
        "stock", (F.row_number().over(W.orderBy("stock")) - 1).alias("no"))


def read_wide_files(spark: SparkSession, path: str | list[str], value: str = "return_1d") -> DataFrame:
    """(date, stock, value) from CSV files whose header is a date column and one column a stock.

    Each file has its own header, in any order of the stocks; lines are split, so a large file is read by many tasks.
    Cells that are empty or no number are left out, as are lines without a date; where a header names a stock twice,
    the first column counts.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "[\r]$", "").alias("line"))
    # a quoted line is taken apart cell by cell, a plain one split
    cells = F.when(F.col("line").contains('"'), cells_of("line")).otherwise(F.split("line", ",", -1))
    lines = lines.withColumn("cells", cells)
    first = F.lower(F.trim(F.col("cells")[0]))
    names = F.transform("cells", lambda c: F.trim(c))
    # a header names stocks; a line without a date may begin with an empty cell too
    named = (first != "") | F.get("cells", F.lit(1)).try_cast("double").isNull()
    head = first.isin(*DATE_NAMES) & (F.size("cells") > 1) & named
    headers = lines.filter(head).groupBy("file").agg(F.min(F.struct((first == "").alias("unnamed"), names.alias("names"))).alias("h"))
    headers = stage(headers.select("file", "h.names"), "wide-headers")
    day = F.substring(F.trim(F.col("cells")[0]), 1, 10).try_cast("date")
    rows = lines.withColumn("date", day).filter(F.col("date").isNotNull()).join(headers, "file")
    # (place, name, cell) of the known cells; a name's later places fall away
    dealt = rows.select("file", "date", F.posexplode(F.arrays_zip("names", "cells")).alias("place", "x")).filter("place > 0")
    twice = (headers.select("file", F.posexplode("names").alias("place", "stock")).groupBy("file", "stock")
             .agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    number = null_if_nan(F.trim(F.col("x.cells")).try_cast("double"))
    long = dealt.select("file", "date", "place", F.col("x.names").alias("stock"), number.alias(value))
    long = long.filter(F.col(value).isNotNull() & F.col("stock").isNotNull() & (F.col("stock") != ""))
    return (long.join(stage(twice, "repeated-names"), ["file", "stock"], "left")
            .filter(F.col("first").isNull() | (F.col("place") == F.col("first"))).select("date", "stock", value))


def matrix_rows(long: DataFrame, numbers: DataFrame, value: str = "return_1d") -> DataFrame:
    """(date, values): an array of doubles by the number of the stock, null where a stock has no value.

    (date, stock) is unique, or the least value counts. Stocks that ``numbers`` lacks raise an error.
    """
    numbers = stage(numbers, "stock-numbers")
    n = numbers.count()

    def dense(table: pa.Table) -> pa.Table:
        values, known = np.zeros(n), np.zeros(n, bool)
        table = table.sort_by([(value, "descending")])          # the least is written last
        no = table["no"].to_numpy()
        values[no], known[no] = table[value].to_numpy(), True
        row = pa.array([pa.array(values, mask=~known).to_pylist()], pa.list_(pa.float64()))
        return pa.table([table["date"].slice(0, 1).combine_chunks(), row], names=["date", "values"])

    placed = long.join(numbers, "stock", "left").filter(F.col(value).isNotNull()).select(
        "date", F.coalesce("no", F.raise_error(F.concat(F.lit("no number for stock "), F.col("stock"))).cast("int")).alias("no"),
        F.col(value).cast("double").alias(value))
    return placed.groupBy("date").applyInArrow(dense, "date date, values array<double>")


def from_matrix(rows: DataFrame, numbers: DataFrame, value: str = "return_1d") -> DataFrame:
    """(date, stock, value) of the cells that are known."""
    return (rows.select("date", F.posexplode("values").alias("no", value)).filter(F.col(value).isNotNull())
            .join(stage(numbers, "stock-numbers"), "no").select("date", "stock", value))


def write_wide_files(rows: DataFrame, numbers: DataFrame, path: str, files: int = 1) -> None:
    """Matrix rows as CSV files with a column a stock, in the order of the numbers; dates are dealt over ``files``.

    These are folders: of one file for up to ``STOCKS`` stocks, and of one more, written by a task of its own and with the
    header, for every so many stocks beyond; so a file grows with the calendar alone.
    """
    runs = max(1, -(-numbers.count() // STOCKS))
    days = F.datediff("date", F.lit("1970-01-01").cast("date"))
    names = numbers.agg(F.array_sort(F.collect_list(F.struct("no", "stock"))).alias("s"))      # one cell a stock
    quoted = F.transform("s.stock", lambda s: F.when(s.rlike('[",]'), F.concat(
        F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s))
    header = names.select(F.explode(F.sequence(F.lit(0), F.lit(files - 1))).alias("part"), F.lit(None).cast("date").alias("date"),
                          F.concat(F.lit("date,"), F.array_join(quoted, ",")).alias("value"))
    header = header.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))))
    lines = rows.select(F.pmod(days, F.lit(files)).alias("part"), F.pmod(F.floor(days / files), F.lit(runs)).alias("run"), "date", F.concat(
        F.col("date").cast("string"), F.lit(","), F.array_join(F.transform("values", lambda v: v.cast("string")), ",", "")).alias("value"))
    (header.unionByName(lines).repartition(files * runs, "part", "run").sortWithinPartitions("part", F.asc_nulls_first("date"))
     .select("part", "value").write.partitionBy("part").text(path))
