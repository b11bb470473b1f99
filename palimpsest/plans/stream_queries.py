"""The stream form of change detection over ``events``; its SQL is that of the batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import detect
from .registry import query, table
from .version_queries import _POLLS


def polls_of(events: DataFrame) -> DataFrame:
    error = F.when(F.col("event_type") == "error", F.lit("error"))
    return events.select(F.col("user_id").alias("name"), "ts", F.col("event_id").alias("poll_id"), F.col("event_type").alias("key"), F.regexp_extract("props", "[0-9]+", 0).alias("hash"), error.alias("error"))


@query(f"WITH {_POLLS} SELECT event_id AS poll_id, user_id AS name, status FROM s")
def stream_change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.run_stream(spark, sf_dir, table(spark, sf_dir, "events").schema, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", polls_of, glob="events.parquet")


@query("SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.windowed_counts(table(spark, sf_dir, "events"))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")
