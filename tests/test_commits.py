"""Several tables become visible together or not at all."""

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import writers as W


def frames(spark, n):
    versions = spark.createDataFrame([(i, f"s{i % 2}") for i in range(n)], "id long, source string")
    return {"versions": versions, "sections": versions.select("id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("key"))}


def counts(spark, base, version=None):
    return {name: df.count() for name, df in W.committed_tables(spark, base, version).items()}


def test_a_commit_that_breaks_off_shows_the_old_state(spark, tmp_path):
    base = f"file://{tmp_path}/store"
    assert counts(spark, base) == {}
    assert W.commit_tables(frames(spark, 3), base, 0, {"versions": ["source"]})
    assert counts(spark, base) == {"versions": 3, "sections": 6}
    broken = frames(spark, 5)
    broken["sections"] = broken["sections"].withColumn("key", F.raise_error(F.lit("killed between two tables")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        W.commit_tables(broken, base, 1)
    assert counts(spark, base) == {"versions": 3, "sections": 6}
    assert [tuple(r) for r in W.abandoned_folders(spark, base, ["versions", "sections"]).collect()] == [("versions", 1)]
    assert W.commit_tables(frames(spark, 4), base, 1)
    assert counts(spark, base) == {"versions": 4, "sections": 8} and counts(spark, base, 0) == {"versions": 3, "sections": 6}
    assert not W.commit_tables(frames(spark, 9), base, 1) and counts(spark, base)["versions"] == 4
    assert W.abandoned_folders(spark, base, ["versions", "sections"]).count() == 0
    assert (tmp_path / "store/versions/v000000000000/source=s1").is_dir()


def test_batches_of_a_stream_commit_once(spark, tmp_path):
    source, base = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).coalesce(1).write.mode("append").parquet(source)

    def each(batch, number):
        old = W.committed_tables(batch.sparkSession, base, number - 1)
        rows = batch if not old else batch.unionByName(old["rows"])
        W.commit_tables({"rows": rows, "total": rows.agg(F.sum("id").alias("total"))}, base, number)
        W.commit_tables({"rows": batch, "total": batch}, base, number)  # the batch runs again

    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    tables = W.committed_tables(spark, base)
    assert tables["rows"].count() == 30 and tables["total"].first()["total"] == sum(range(30))
