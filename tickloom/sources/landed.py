"""Readers for landed files: instrument masters, bar files of two kinds, return tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.functions.scalar import null_if_nan
from tickloom.operators.clean import coerce
from tickloom.operators.panel import to_long
from tickloom.schema import BAR_FILE, INSTRUMENT, PRICES
from tickloom.staging import stage

FILE_STEM = r"([^/]+)\.[^./]+$"


def read_instruments(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Instrument master: one JSON list of records, or JSON lines with ``multi_line=False``."""
    return spark.read.schema(INSTRUMENT).json(path, multiLine=multi_line)


def _instrument(pattern: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def cells_of(line: str) -> Column:
    """The cells of one line of CSV; a quoted cell may hold commas and doubled quotes."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), F.col(line)), F.lit(r',(?:\s*"((?:[^"]|"")*+)"[^,]*+|([^,]*+))'), F.lit(0))
    return F.transform(cells, lambda c: F.when(
        c.rlike(r'^,\s*"'), F.replace(F.regexp_extract(c, r'^,\s*"((?:[^"]|"")*+)"', 1), F.lit('""'), F.lit('"'))
    ).otherwise(F.substring(c, F.lit(2), F.length(c))))


def _plain_or_quoted(line: str) -> Column:
    """``cells_of`` where the line has a quote; any other line is split, which takes a fraction of the time."""
    return F.when(F.col(line).contains('"'), cells_of(line)).otherwise(F.split(line, ",", -1))


def read_bar_files(spark: SparkSession, path: str | list[str], stem: str = FILE_STEM) -> DataFrame:
    """Clean bar files ``datetime, open, high, low, close, volume, symbol``, whole folder at once.

    A file whose header has other names or another order fails instead of being misread.
    """
    raw = spark.read.schema(BAR_FILE).csv(path, header=True, recursiveFileLookup=True, enforceSchema=False)
    return raw.select(
        F.substring("datetime", 1, 10).try_cast("date").alias("date"),
        F.coalesce("symbol", _instrument(stem)).alias("stock"),
        *[null_if_nan(F.col(c)).alias(c) for c in [*PRICES, "volume"]])


def read_dirty_bar_files(spark: SparkSession, path: str | list[str], stem: str = FILE_STEM) -> DataFrame:
    """Bar files whose header differs from file to file and which may hold junk rows.

    Read line by line, so that a large file is split; the text is read twice, for headers and for
    rows. Cells may be quoted. A header is the line that names a value column; column places come
    from the file's own header, also where files in different folders share a name. Names are
    trimmed and lower-cased, ``close`` is preferred to ``adj close``, and a file without all five
    value columns is left out. The first column is the date. Rows with no number in them are dropped.
    """
    columns = [*PRICES, "volume"]
    value = F.col("value")
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"),
        F.when(value.contains("\r"), F.regexp_replace(value, r"\r$", "")).otherwise(value).alias("line"))
    names = F.transform(_plain_or_quoted("line"), lambda c: F.lower(F.trim(c)))
    place = {c: F.array_position("names", c) for c in columns}
    place["close"] = F.when(place["close"] > 0, place["close"]).otherwise(
        F.array_position("names", "adj close"))
    # one short row a file; staged, so that its size decides how it is joined. Lines without a letter need no pattern
    letters = F.lower("line") != F.upper("line")
    headers = (lines.filter(letters & F.lower("line").rlike("|".join(columns))).withColumn("names", names)
               .filter(F.arrays_overlap("names", F.array(*[F.lit(c) for c in columns])))
               .groupBy("file").agg(F.min("names").alias("names"))
               .select("file", F.regexp_extract("file", stem, 1).alias("stock"),
                       *[p.cast("int").alias(f"at_{c}") for c, p in place.items()]))
    for c in columns:
        headers = headers.filter(F.col(f"at_{c}") > 0)
    cells = lines.join(stage(headers, "headers"), "file").withColumn("cells", _plain_or_quoted("line"))
    text = cells.select(
        F.substring(F.trim(F.col("cells")[0]), 1, 10).try_cast("date").alias("date"), "stock",
        *[F.trim(F.try_element_at("cells", F.col(f"at_{c}"))).alias(c) for c in columns])
    values = coerce(text, columns).na.drop("all", subset=columns)
    return values.filter(F.col("date").isNotNull())


def is_long(columns: list[str]) -> bool:
    header = ",".join(columns).lower()
    return "stock" in header and "return" in header


def as_long_returns(df: DataFrame) -> DataFrame:
    """(date, stock, return_1d) from either layout of a return table."""
    if is_long(df.columns):
        return df.select("date", "stock", "return_1d")
    return to_long(df).select("date", "stock", "return_1d")


def landed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files in a folder; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select("path", "length"))


def not_ingested(landed: DataFrame, ledger: DataFrame, on: str | list[str] = "path") -> DataFrame:
    return landed.join(ledger, on, "left_anti")
