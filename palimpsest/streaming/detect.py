"""Change detection as a stream: polls arrive, the last state of each target is kept, changes go out.

Each micro-batch is one relational plan: the batch's polls after the kept state of their targets, in one window by
target. The state is a table of one row a target, written as a new snapshot for each batch; a batch that runs again
overwrites its own output and snapshot, so results are exactly once. A failed poll goes out and leaves the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.versions import last_good, poll_status

STATE = "name long, ts timestamp_ntz, poll_id long, key string, hash string"


def detect_batch(polls: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(poll_id, name, status) of the batch, and the state after it. ``polls``: the columns of the state and ``error``."""
    kept = state.join(polls.select("name").distinct(), "name", "left_semi").withColumns({"error": F.lit(None).cast("string"), "_old": F.lit(True)})
    rows = polls.withColumn("_old", F.lit(False)).unionByName(kept)
    w = Window.partitionBy("name").orderBy(F.desc("_old"), "ts", "poll_id")
    good = F.col("error").isNull() & F.col("key").isNotNull()
    status = poll_status(last_good("key", good, w), F.col("key"), last_good("hash", good, w), F.col("hash"), F.col("error"))
    out = rows.withColumn("status", status).where("not _old").select("poll_id", "name", "status")
    last = rows.where(good).groupBy("name").agg(F.max_by(F.struct("ts", "poll_id", "key", "hash"), F.struct(~F.col("_old"), "ts", "poll_id")).alias("s")).select("name", "s.*")
    return out, state.join(last.select("name"), "name", "left_anti").unionByName(last)


def run_stream(spark: SparkSession, source: str, schema: StructType, base: str, to_polls, glob: str | None = None, files_per_batch: int = 1) -> DataFrame:
    """Reads all files of ``source`` in batches, and gives every status written. ``base``: a shared folder of this stream."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        stream = stream.option("pathGlobFilter", glob)

    def each(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        state = session.read.schema(STATE).parquet(f"{base}/state/{number - 1}") if number else session.createDataFrame([], STATE)
        out, new = detect_batch(to_polls(batch), state)
        out.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        new.write.mode("overwrite").parquet(f"{base}/state/{number}")

    query = stream.parquet(source).writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


def windowed_counts(stream: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Tumbling counts with a watermark; ``ts`` is taken as UTC."""
    timed = stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width), by).agg(F.count("*").alias("n"))
