"""The online protocol on Structured Streaming.

Windowed steps use watermarks and append mode; per-key trackers keep their state
vector in the state store; the pooled tracker keeps a small state table and
advances over the dates that are complete.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import normalized, ratio
from ..operators import pooled as PO
from ..session import shared_folder, written
from . import trackers  # noqa: F401
from .trackers import entity_tracker  # noqa: F401


def run_to_table(df: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Process all that is available and return the written result. With the ``base`` of an
    earlier run it goes on where that one ended."""
    spark = df.sparkSession
    base = base or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = (df.writeStream.outputMode(mode).format("parquet").option("path", base + "/out")
         .option("checkpointLocation", base + "/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(base + "/out")


def read_table(spark: SparkSession, folder: str, name: str, per_trigger: int | None = None) -> DataFrame:
    """A landed parquet table as a stream."""
    path = f"{folder}/{name[:-1]}[{name[-1]}].parquet"
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    df = reader.parquet(path)
    for f in schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def read_landed(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


# --- windows ---------------------------------------------------------------------

def bars(ticks: DataFrame, width: str, late: str) -> DataFrame:
    o = F.struct("ts", "event_id")
    return (ticks.withWatermark("ts", late).groupBy("key", F.window("ts", width))
            .agg(F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
                 F.max_by("price", o).alias("close"), F.count(F.lit(1)).alias("n_trades")))


def daily_variance(ticks: DataFrame, width: str, late: str) -> DataFrame:
    """Bars, then a second window over the day: at most one close per bar is kept
    for each (key, day)."""
    b = bars(ticks, width, late)
    day = b.groupBy("key", F.window(F.window_time("window"), "1 day").alias("day")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("window.start").alias("t"), "close"))).alias("c"))
    n = F.size("c")
    steps = F.zip_with(F.slice("c", 2, F.greatest(n - 1, F.lit(0))), F.slice("c", 1, F.greatest(n - 1, F.lit(0))),
                       lambda a, p: F.log(ratio(a["close"], p["close"])))
    rv = F.aggregate(F.transform(steps, lambda r: r * r), F.lit(0.0), lambda s, v: s + v)
    return day.select("key", F.to_date("day.start").alias("date"), rv.alias("rv"), n.alias("n_bars"))


def news_daily(news: DataFrame, late: str) -> DataFrame:
    """Counts and scores per key and effective day. Rows: key, effective, shock."""
    d = news.withColumn("at", F.col("effective").cast("timestamp")).withWatermark("at", late)
    return (d.groupBy("key", F.window("at", "1 day")).agg(F.sum("shock").alias("shock"), F.count(F.lit(1)).alias("n"))
            .select("key", F.to_date("window.start").alias("date"), "shock", "n"))


def dedup(rows: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def episodes(rows: DataFrame, gap: str, late: str, flag) -> DataFrame:
    """Sessions of flagged rows; the gap is calendar time. The watermark follows all
    rows, so quiet periods still close sessions: the filter names the time column,
    which keeps it from being moved below the watermark."""
    d = rows.withWatermark("ts", late).filter(F.when(F.col("ts").isNull(), F.lit(False)).otherwise(flag))
    return (d.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
            .select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n"))


def expert_losses(preds: DataFrame, losses: dict, late: str) -> DataFrame:
    """Mean loss of every expert per date, issued once the date is complete."""
    d = preds.withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", late)
    agg = d.groupBy(F.window("at", "1 day")).agg(*[F.avg(c).alias(n) for n, c in losses.items()])
    return agg.select(F.to_date("window.start").alias("date"), *losses)


# --- per-key trackers ---------------------------------------------------------------

def run_length(rows: DataFrame) -> DataFrame:
    """Consecutive flagged observations per key; rows: key, date, flag."""
    def step(key, pdfs, state: GroupState):
        pdf = pd.concat(list(pdfs)).sort_values("date")
        run, out = (state.get[0] if state.exists else 0), []
        for d, f in zip(pdf["date"], pdf["flag"]):
            run = run + 1 if f else 0
            out.append((key[0], d, run))
        state.update((run,))
        yield pd.DataFrame(out, columns=["key", "date", "run"])
    return rows.groupBy("key").applyInPandasWithState(step, "key string, date date, run int", "run int", "append", GroupStateTimeout.NoTimeout)


# --- pooled tracker ----------------------------------------------------------------

ROWS = "key string, date date, s_std double, sigma_hat double"
GENERATION = "batch long, pending string, state array<double>, closed date"
THRESHOLDS = "arm string, date date, warm boolean, q_lo double, q_hi double, rates array<double>, state array<double>"


class PanelTracker:
    """Pooled thresholds over a stream of scored rows (key, date, s_std, sigma_hat).

    A date closes when a later date has arrived. Rows of closed dates go to a side
    table and never change a threshold. Pending rows, thresholds and the state are
    Parquet tables under ``base`` in the shared folder. Every batch writes a new
    generation and starts from the newest one before it, so a repeated batch, or a
    new driver given the same ``base``, goes on where the tables end.
    """

    def __init__(self, spark: SparkSession, walk: Callable[[], PO.FixedWalk], membership: DataFrame, k: int,
                 start: dict[str, float], base: str | None = None):
        if not hasattr(walk(), "resume"):
            raise TypeError("a walk without a state cannot go on from batch to batch")
        self.spark, self.walk, self.membership, self.k, self.start = spark, walk, membership, k, start
        self.base = base or f"{shared_folder(spark)}/tracker-{uuid.uuid4().hex}"
        self._save(-1, "", [], None)

    def _save(self, batch, pending, state, closed) -> None:
        row = self.spark.createDataFrame([(batch, pending, state, closed)], GENERATION)
        row.write.mode("ignore" if batch < 0 else "overwrite").parquet(f"{self.base}/state/g={batch}")

    def _before(self, batch: int):
        """The generation that a batch starts from: the one before it, or, if numbers
        were left out, the newest one below."""
        read = self.spark.read.schema(GENERATION)
        try:
            return read.parquet(f"{self.base}/state/g={batch - 1}").first()
        except AnalysisException:
            return read.parquet(f"{self.base}/state/*").filter(F.col("batch") < batch).orderBy(F.desc("batch")).first()

    def _table(self, path: str, schema: str = ROWS) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        last = self._before(batch)
        arrived = f"{self.base}/arrived/batch={batch}"
        rows.select("key", "date", "s_std", "sigma_hat").write.mode("overwrite").parquet(arrived)
        held = self._table(arrived)
        if last["closed"] is not None:
            held.filter(F.col("date") <= F.lit(last["closed"])).write.mode("overwrite").parquet(f"{self.base}/late/batch={batch}")
            held = held.filter(F.col("date") > F.lit(last["closed"]))
        if last["pending"]:
            held = held.unionByName(self._table(last["pending"]))
        newest = held.agg(F.max("date").alias("d")).first()["d"]
        if newest is None:
            self._save(batch, last["pending"], last["state"], last["closed"])
            return
        keep = f"{self.base}/pending/batch={batch}"
        held.filter(F.col("date") == F.lit(newest)).write.mode("overwrite").parquet(keep)
        ready = held.filter(F.col("date") < F.lit(newest))
        closed = ready.agg(F.max("date").alias("d")).first()["d"]
        if closed is None:
            self._save(batch, keep, last["state"], last["closed"])
            return
        out = f"{self.base}/thresholds/batch={batch}"
        path = self._advance(ready, last["state"])
        path.write.mode("overwrite").parquet(out)
        end = self._table(out, THRESHOLDS).agg(F.max_by("state", "date").alias("s")).first()["s"]
        self._save(batch, keep, list(end), closed)

    def _advance(self, ready: DataFrame, state) -> DataFrame:
        dates = ready.select("date").distinct().join(self.membership.select("date", "pi"), "date", "left")
        cal = dates.withColumn("pi", normalized(F.col("pi"), self.k)).withColumn("warm", F.lit(False)) \
            .withColumn("q0_hi", F.lit(float(self.start["hi"]))).withColumn("q0_lo", F.lit(float(self.start["lo"])))
        make, before = self.walk, list(state or [])
        return PO.thresholds(ready, written(cal), {"stream": lambda pdf, state=None: PO._walk(pdf, make(), state or before, True)}, resumable=True)

    def finish(self) -> DataFrame:
        """Thresholds of all closed dates."""
        return self.spark.read.schema(THRESHOLDS).parquet(f"{self.base}/thresholds/*").select("date", "q_lo", "q_hi")

    def late(self) -> DataFrame:
        """Rows that arrived after their date had closed."""
        return self.spark.read.schema(ROWS).parquet(f"{self.base}/late/*")


def run_panel_tracker(stream: DataFrame, tracker: PanelTracker) -> DataFrame:
    q = (stream.writeStream.foreachBatch(tracker).option("checkpointLocation", tracker.base + "/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return tracker.finish()
