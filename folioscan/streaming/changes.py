"""Annotation changes as a stream: each micro-batch is appended to the change log, which replay() folds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.session import shared_dir, table

ACTIONS = {"signup": "add", "click": "update", "view": "update", "purchase": "update", "error": "remove"}


def change_log(events: DataFrame) -> DataFrame:
    """(id, seq, action, state) of events: the user is the annotation, and time, then event_id, is the order."""
    action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])[F.col("event_type")]
    return events.select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("seq"), action.alias("action"), F.col("value").alias("state")).where("action IS NOT NULL")


def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream the events into a change log in the shared folder, and read the log. A restarted run goes on from its checkpoint."""
    where = f"{shared_dir(spark)}/folioscan/changes-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    log = change_log(stream)
    log.writeStream.format("parquet").option("checkpointLocation", f"{where}/checkpoint").option("path", f"{where}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(log.schema).parquet(f"{where}/log")
