"""The driver's tables and the panels derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import BROADCAST_ROWS
from ..session import prepare, written

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings "
         "pages benchmark labels conversations").split()


class Tables:
    """Lazy access to one folder of parquet tables. Timestamps without a zone
    are read as UTC instants."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder.rstrip("/")
        self._kept: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(self.path(name))
        for f in df.schema.fields:
            if f.dataType.typeName() == "timestamp_ntz":
                df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name in NAMES:
            return self.read(name)
        raise AttributeError(name)

    def _panel(self, day, key) -> DataFrame:
        """Shipments per (place, day). A short list of suppliers is broadcast, so
        one map-side aggregate does all the work. A long one is joined after the
        sums per (supplier, day), which collapse a hot supplier before the shuffle."""
        place = (self.supplier.join(self.nation, F.col("s_nationkey") == F.col("n_nationkey"))
                 .select("s_suppkey", key.cast("string").alias("key")))
        rows = self.lineitem.select("l_suppkey", day.alias("date"), "l_extendedprice", "l_quantity")
        same = F.col("l_suppkey") == F.col("s_suppkey")
        if self.supplier.count() <= BROADCAST_ROWS:
            parts = rows.join(F.broadcast(place), same).select(
                "key", "date", F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"), F.lit(1).alias("n"))
        else:
            parts = rows.groupBy("l_suppkey", "date").agg(
                F.sum("l_extendedprice").alias("price"), F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n")
            ).join(place, same)
        return parts.groupBy("key", "date").agg(F.log(F.sum("price")).alias("x"), F.sum("qty").alias("qty"), F.sum("n").alias("n"))

    def panel_a(self) -> DataFrame:
        """Region x day: key, date, x (log value), qty, n."""
        return self._panel(F.to_date("l_shipdate"), F.col("n_regionkey"))

    def panel_b(self) -> DataFrame:
        """Nation x week: a wider cross-section for the pooled operators."""
        return self._panel(F.to_date(F.date_trunc("week", "l_shipdate")), F.col("s_nationkey"))

    def table_a(self) -> DataFrame:
        """Panel A written once, for chains that read it several times."""
        return self._once("a", self.panel_a)

    def table_b(self) -> DataFrame:
        return self._once("b", self.panel_b)

    def _once(self, name, make) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = written(make())
        return self._kept[name]

    def ticks(self) -> DataFrame:
        return self.events.select(F.col("event_type").alias("key"), "ts", "event_id",
                                  F.col("value").alias("price"))
