"""The panel clustered by stock: bucketed files, so that windows and aggregations by stock need no shuffle.

``<path>/<id>`` holds one file a bucket, in the order of (stock, date); the log of commits beside it names the folder
that counts, the number of buckets and the columns, so that any session can open the table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T

from tickloom.sources.commits import CommitLog

BUCKETS = 64


def write_by_stock(panel: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replace the clustered table by ``panel`` in one commit; readers of the folder before keep it."""
    spark, path = panel.sparkSession, path.rstrip("/")
    log = CommitLog(spark, path)
    begun, _ = log.state()
    name = f"by_stock_{uuid.uuid4().hex}"
    (panel.repartition(buckets, "stock").sortWithinPartitions("stock", "date")
     .write.bucketBy(buckets, "stock").sortBy("stock", "date").option("path", f"{path}/{name}").saveAsTable(name))
    log.commit(begun, {"table": name, "buckets": buckets, "schema": panel.schema.json()})


def read_by_stock(spark: SparkSession, path: str) -> DataFrame:
    """The clustered table; Spark knows that its rows are dealt by stock, and reads one bucket for one stock."""
    path = path.rstrip("/")
    _, state = CommitLog(spark, path).state()
    if not state:
        raise FileNotFoundError(f"no table by stock at {path}")
    name = state["table"]
    if not spark.catalog.tableExists(name):
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (stock) SORTED BY (stock, date) "
                  f"INTO {state['buckets']} BUCKETS LOCATION '{path}/{name}'")
    return spark.table(name)
