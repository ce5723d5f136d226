"""The panel's two jobs as plans: building it from landed files, and its daily refresh."""

from __future__ import annotations

from datetime import date

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.operators.clean import absent_instruments, known_only
from tickloom.operators.panel import choose_source, fresh_rows, merge_sources, one_row_per_day
from tickloom.sources.landed import landed_files, not_ingested, read_bar_files
from tickloom.sources.tables import PanelTable, in_months, read_panel, write_panel
from tickloom.staging import stage
from tickloom.streaming.bars import upsert_batch


def build_panel(spark: SparkSession, instruments: DataFrame, older: DataFrame, newer: DataFrame, path: str,
                cutoff: date, min_obs: int = 50) -> DataFrame:
    """Write the panel of the listed stocks from two bar tables; (stock) of those that were skipped.

    ``instruments`` has one ``clean_symbol`` per stock. The older source counts before ``cutoff``
    only; stocks with fewer than ``min_obs`` returns are left out.
    """
    listed = stage(instruments.select(F.col("clean_symbol").alias("stock")).distinct(), "listed")
    write_panel(merge_sources(known_only(older, listed), known_only(newer, listed), cutoff, min_obs), path)
    return absent_instruments(listed, read_panel(spark, path).select("stock").distinct())


def refresh(spark: SparkSession, path: str, primary: DataFrame, fallback: DataFrame, overlap_days: int = 7,
            watermark: str = "global") -> DataFrame:
    """Bring the stored panel up to date from two sources of bars; the rows that were new.

    Only stocks of the panel count; each takes the first source, or the second where the first has
    nothing of it. Rows of the overlap seed the returns. Of the table no more than the stocks' last
    days are read to find the news, and only the months that these touch are read whole and replaced,
    all by one commit. A refresh that is run again changes nothing; one that dies leaves the old panel.
    """
    known = stage(PanelTable(spark, path).last_days(), "last-days")
    stocks = known.select("stock")
    batch = choose_source(known_only(primary, stocks), known_only(fallback, stocks))
    news = stage(fresh_rows(batch, known, watermark, overlap_days), "news")
    upsert_batch(spark, path)(news, 0)
    return news


def ingest(spark: SparkSession, path: str, landing: str,
           read: Callable[[SparkSession, list[str]], DataFrame] = read_bar_files, most: int | None = None) -> DataFrame:
    """Take the files of ``landing`` that the table's ledger lacks into the table at ``path``; (path, length) of them.

    Rows and ledger appear by one commit: a run that dies before it has taken nothing, and the next one takes the same
    files again; after it no file is taken twice. Rows are keyed by (stock, date): a day of a later run replaces an
    earlier one's, inside a run the least values stay. ``most`` limits the files of one run, in order of path.
    A file counts as another one when its length has changed.
    """
    table = PanelTable(spark, path)
    begun, _ = table.log.state()
    todo = stage(not_ingested(landed_files(spark, landing), table.ingested(), ["path", "length"]), "arrivals")
    if most is not None:
        todo = stage(todo.orderBy("path").limit(most), "arrivals-now")
    names = [r["path"] for r in todo.select("path").collect()]        # the listing, which a reader needs on the driver
    if not names:
        return todo
    news = stage(read(spark, names).filter(F.col("date").isNotNull() & F.col("stock").isNotNull()), "ingested-rows")
    months = [r[0] for r in news.select(F.year("date") * 100 + F.month("date")).distinct().collect()]   # calendar months
    merged = news.withColumn("newness", F.lit(0))
    stored = table.read(begun) if begun else None
    if stored is not None:
        merged = merged.unionByName(in_months(stored, months).select(news.columns).withColumn("newness", F.lit(1)))
    table.replace(one_row_per_day(merged, ["stock", "date"], [F.col("newness")]).drop("newness"), begun, files=todo)
    table.vacuum()
    return todo
