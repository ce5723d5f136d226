"""Parquet tables: pruned scans, the panel in month folders with its commits, dated snapshots."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.sources.commits import FOLDER, CommitConflict, CommitLog


def scan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def stock_history(panel: DataFrame, stock: str) -> DataFrame:
    """One stock in date order; the filter reaches the Parquet scan."""
    return panel.filter(F.col("stock") == stock).orderBy("date")


PARTS = {"year": F.year, "month": F.month}
KEEP = 8                        # versions whose files stay for readers that began with them


def _folders(months: dict[str, str], root: str) -> list[str]:
    """The folders of months, written as {year-month: version}."""
    return [f"{root}/v={v}/year={m.split('-')[0]}/month={m.split('-')[1]}" for m, v in sorted(months.items())]


def _spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Range partitions by month and ``keys``, which also split a stock or month that is much larger than others."""
    parts = [*PARTS]
    return (df.withColumns({name: of("date") for name, of in PARTS.items()})
            .repartitionByRange(*parts, *keys).sortWithinPartitions(*parts, *keys))


class PanelTable:
    """A panel in month folders whose state changes by whole commits.

    ``<path>/v=<id>/year=/month=`` holds what one commit wrote, files by ranges of (stock, date); ``<path>/_last`` has
    the last day of each stock in each month in the same folders. A commit names the version of each month, so it
    replaces all of its months at once or none, and carries a ledger: the last batch of each sink, and tables of the
    files that were ingested. A reader keeps the version that it began with for ``KEEP`` commits. Use ``read_panel``;
    a plain scan of the folder would see every version.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, self.path)

    def _scan(self, root: str, months: dict[str, str]) -> DataFrame | None:
        if not months:
            return None
        return self.spark.read.option("basePath", root).parquet(*_folders(months, root)).drop("v")

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table with its folder columns; None before its first commit."""
        return self._scan(self.path, self.log.state(version)[1].get("months", {}))

    def last_days(self) -> DataFrame | None:
        """(stock, date): the last day of each stock, from one row a stock and month."""
        months = self._scan(f"{self.path}/_last", self.log.state()[1].get("months", {}))
        return None if months is None else months.groupBy("stock").agg(F.max("date").alias("date"))

    def batch_of(self, sink: str) -> int | None:
        return self.log.state()[1].get("batches", {}).get(sink)

    def ingested(self) -> DataFrame:
        """(path, length): the files of the ledger."""
        tables = self.log.state()[1].get("ingested", [])
        if not tables:
            return self.spark.createDataFrame([], "path string, length long")
        return self.spark.read.schema("path string, length long").parquet(*[f"{self.path}/_ingested/{t}" for t in tables])

    def replace(self, rows: DataFrame, after: int | None = None, batch: tuple[str, int] | None = None,
                files: DataFrame | None = None) -> int:
        """Commit ``rows`` as the whole content of the months that they touch, and with them a sink's batch or the files
        that they come from. ``after`` is the version that ``rows`` were made from.

        Nothing is visible before the commit; what a writer that died has left is never read. Where another writer has
        committed since ``after``, the commit stands if it touched other months, and else raises ``CommitConflict``.
        """
        base, begun = self.log.state(after)
        version = uuid.uuid4().hex
        folder = f"{self.path}/v={version}"
        _spread(rows, ["stock", "date"]).write.partitionBy(*PARTS).parquet(folder)
        months = {}
        if any(n.startswith("year=") for n in self.log.names(f"v={version}")):
            written = self.spark.read.parquet(folder)
            last = written.groupBy(*PARTS, "stock").agg(F.max("date").alias("date"))
            last.repartition(*PARTS).write.partitionBy(*PARTS).parquet(f"{self.path}/_last/v={version}")
            months = {f"{year[5:]}-{month[6:]}": version for year in self.log.names(f"v={version}") if year.startswith("year=")
                      for month in self.log.names(f"v={version}/{year}")}
        ledger = None
        if files is not None:
            ledger = version
            files.select("path", "length").write.parquet(f"{self.path}/_ingested/{ledger}")
        while True:
            now, state = (base, begun) if base is not None else self.log.state()
            state = {"months": {}, "batches": {}, "ingested": [], **state}
            state["months"] = state["months"] | months
            if batch:
                state["batches"] = state["batches"] | {batch[0]: batch[1]}
            if ledger:
                state["ingested"] = [*state["ingested"], ledger]
            try:
                return self.log.commit(now, state)
            except CommitConflict:
                other = self.log.state()[1]
                changed = {m for m in months if other.get("months", {}).get(m) != begun.get("months", {}).get(m)}
                if changed or ledger or batch and other.get("batches", {}).get(batch[0]) != begun.get("batches", {}).get(batch[0]):
                    raise
                base = None

    def vacuum(self, keep: int = KEEP) -> None:
        """Remove the files that only versions before the last ``keep`` name."""
        versions = self.log.versions()
        used = {v for n in versions[-keep:] for v in self.log.state(n)[1].get("months", {}).values()}
        known = {v for n in versions[:-keep] for v in self.log.state(n)[1].get("months", {}).values()}
        for v in sorted(known - used):
            self.log.remove(f"v={v}")
            self.log.remove(f"_last/v={v}")
        for n in versions[:-keep]:
            self.log.remove(f"{FOLDER}/{n:010}.json")


def write_panel(panel: DataFrame, path: str) -> None:
    """Write the months present in ``panel`` by one commit; other months of the table stay."""
    PanelTable(panel.sparkSession, path).replace(panel)


def read_panel(spark: SparkSession, path: str, since: date | None = None, before: date | None = None,
               version: int | None = None) -> DataFrame:
    """The panel at its last commit, or a span of it for which only the folders concerned are opened."""
    df = PanelTable(spark, path).read(version)
    if df is None:
        raise FileNotFoundError(f"no panel at {path}")
    folder = F.col("year") * 100 + F.col("month")
    if since is not None:
        df = df.filter((folder >= since.year * 100 + since.month) & (F.col("date") >= F.lit(since)))
    if before is not None:
        df = df.filter((folder <= before.year * 100 + before.month) & (F.col("date") < F.lit(before)))
    return df.drop(*PARTS)


def stored_panel(spark: SparkSession, path: str) -> DataFrame | None:
    """The table with its folder columns, or None before its first write."""
    return PanelTable(spark, path).read()


def in_months(stored: DataFrame, months: list[int]) -> DataFrame:
    """Rows of the given months, each written as year * 100 + month; no other folder is opened."""
    return stored.filter((F.col("year") * 100 + F.col("month")).isin(months)).drop(*PARTS)


def write_snapshot(df: DataFrame, path: str, as_of: date | Column) -> None:
    """One folder per day; writing a day again replaces that day only."""
    day = as_of if isinstance(as_of, Column) else F.lit(as_of)
    (df.withColumn("as_of", day).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(path))


def latest_snapshot(spark: SparkSession, path: str, column: str = "as_of") -> DataFrame:
    """The newest day's rows. The day is known from the folders' names, so no other folder is opened."""
    folders = [n for n in CommitLog(spark, path).names() if n.startswith(f"{column}=")]
    known = [n for n in folders if not n.endswith("=__HIVE_DEFAULT_PARTITION__")]
    if not known:
        return spark.read.parquet(path).limit(0)
    of = lambda n: n.split("=", 1)[1]
    newest = max(known, key=lambda n: int(of(n))) if all(of(n).isdigit() for n in known) else max(known)
    return spark.read.option("basePath", path).parquet(f"{path}/{newest}")
