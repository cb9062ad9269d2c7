"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def build_session(app: str = "tidepanel", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on; safe on a foreign session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: functions
    inside tasks import it, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tidepanel-code-"), "tidepanel.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(home):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, which all nodes see. On one machine (a local
    master, as in tests) a folder is made if none is named; on a cluster that would
    scatter a table over the nodes, so it is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        folder = tempfile.mkdtemp(prefix="tidepanel-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Spark's setting that drops a query's shuffle files as soon as the query ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """For queries whose result is stored: nothing reads their shuffles again."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing a table to the shared folder and reading it
    back. Survives the loss of executors, unlike cached blocks."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    with freeing_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """As ``written``, dealt by the column: later joins on it leave these rows where they
    are. The session's catalog keeps the table's (unique) name."""
    spark = df.sparkSession
    name = f"dealt_{uuid.uuid4().hex}"
    with freeing_shuffles(spark):
        df.repartition(buckets, column).write.format("parquet").bucketBy(buckets, column).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def measured(df: DataFrame) -> tuple[DataFrame, int]:
    """The written table and its number of rows, read from the file footers."""
    table = written(df)
    return table, table.count()
