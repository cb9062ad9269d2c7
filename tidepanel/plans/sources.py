"""Sources and sinks."""

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import panel as P
from ..sources import readers, sinks
from .registry import query


@query("src_parquet", "SELECT event_id, event_type, r6(value) AS value FROM events")
def src_parquet(t):
    return t.events.select("event_id", "event_type", rnd("value").alias("value"))


@query("src_parquet_cols", """SELECT 'nation' AS file_key, n_name AS name FROM nation""")
def src_parquet_cols(t):
    return (readers.columns_by_file(t.spark, t.path("nation"), ["n_name"])
            .withColumnRenamed("n_name", "name"))


@query("src_csv", "SELECT doc_id, lang AS stock, trim(source) AS title FROM documents")
def src_csv(t):
    path = sinks.fresh_path(t.spark, "csv-source")
    (t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("ticker"),
                        F.trim("source").alias("headline"))
     .write.option("header", True).csv(path))
    df = readers.csv_aliased(t.spark, path, {"doc_id": ["doc_id", "id"], "stock": ["stock", "ticker"],
                                             "title": ["title", "headline"]})
    return df.withColumn("doc_id", F.col("doc_id").cast("bigint"))


SEASON_SQL = """SELECT event_type AS key, CAST(isodow(ts) - 1 AS INTEGER) AS dow,
 r6(avg(value)) AS value FROM events GROUP BY ALL"""


def season_table(t):
    return (t.events.groupBy(F.col("event_type").alias("key"), F.weekday("ts").alias("dow"))
            .agg(rnd(F.avg("value")).alias("value")))


@query("src_json_map", SEASON_SQL)
def src_json_map(t):
    path = sinks.write_json_map(season_table(t), sinks.fresh_path(t.spark, "season"))
    return readers.json_map(t.spark, path)


@query("src_landed_api", """SELECT o_orderkey, o_custkey FROM orders
 WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def src_landed_api(t):
    return readers.landed(t.orders, o_orderstatus="F", o_orderpriority=["1-URGENT", "2-HIGH"]) \
        .select("o_orderkey", "o_custkey")


@query("src_bars", """SELECT event_type AS key, time_bucket(INTERVAL 1 HOUR, ts) AS bar,
 first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
 last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS BIGINT) AS n_trades
 FROM events GROUP BY 1, 2""")
def src_bars(t):
    return P.bars(t.ticks(), "1 hour").select("key", F.col("bar").cast("timestamp_ntz").alias("bar"), "open", "high", "low", "close", "n_trades")


@query("src_events", """SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS date,
 r2(sum(o_totalprice)) AS amount, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1, 2""")
def src_events(t):
    return (t.orders.groupBy(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("date"))
            .agg(rnd(F.sum("o_totalprice"), 2).alias("amount"), F.count(F.lit(1)).alias("n")))


@query("snk_parquet", """SELECT event_type AS key, CAST(ts AS DATE) AS date,
 CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2""")
def snk_parquet(t):
    daily = t.events.groupBy(F.col("event_type").alias("key"), F.to_date("ts").alias("date")) \
        .agg(F.count(F.lit(1)).alias("n"))
    path = sinks.write_parquet(daily, sinks.fresh_path(t.spark, "daily"), ["date"])
    return t.spark.read.parquet(path).select("key", "date", "n")


@query("snk_csv", SEASON_SQL)
def snk_csv(t):
    path = sinks.write_summary_csv(season_table(t), sinks.fresh_path(t.spark, "summary"))
    return t.spark.read.csv(path, header=True, schema="key string, dow int, value double")


@query("snk_json_map", SEASON_SQL)
def snk_json_map(t):
    path = sinks.write_json_map(season_table(t), sinks.fresh_path(t.spark, "season"))
    return readers.json_map(t.spark, path)


@query("snk_artifacts_check", """SELECT 'orders' AS artifact, CAST(count(*) AS BIGINT) AS "rows" FROM orders
 UNION ALL SELECT 'events', CAST(count(*) AS BIGINT) FROM events""")
def snk_artifacts_check(t):
    return sinks.check_artifacts(t.spark, {"orders": t.orders, "events": t.events})
