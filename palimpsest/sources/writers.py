"""Sinks: version snapshots behind a pointer, quarantine, JSON lines, text reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def commit_snapshot(df: DataFrame, base: str, version: int) -> str:
    """Writes a whole snapshot, then a pointer to it; readers see the old one until the pointer is there."""
    path = f"{base}/snapshot-{version:012d}"
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.createDataFrame([(version, path)], "version long, path string").write.mode("append").parquet(f"{base}/pointers")
    return path


def latest_snapshot(spark: SparkSession, base: str) -> DataFrame:
    newest = spark.read.parquet(f"{base}/pointers").agg(F.max_by("path", "version").alias("path")).first()
    return spark.read.parquet(newest["path"])


def quarantine(df: DataFrame, broken, reason, good_path: str, bad_path: str) -> None:
    """Rows that are held back go beside the live table with a reason; the live table never sees them."""
    df.where(~broken).write.mode("append").parquet(good_path)
    df.where(broken).withColumn("reason", reason).write.mode("append").parquet(bad_path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def markdown_table(df: DataFrame, columns: list[str], order: str, width: int = 200) -> DataFrame:
    """(line): rows of a report in order; bars in cells become slashes, cells are cut at ``width``."""
    cells = [F.substring(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("/")), 1, width) for c in columns]
    return df.select(order, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")).orderBy(order).select("line")


def fingerprint(df: DataFrame, sha: str) -> DataFrame:
    """One row that names a table's content whatever its order; derived tables keep it to know when they are stale."""
    return df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum(F.xxhash64(sha).cast("decimal(38,0)")).cast("string")), 256).alias("fingerprint"))


COMMIT = "version long, tables map<string,string>"


def _commits(spark: SparkSession, base: str) -> DataFrame:
    try:
        return spark.read.schema(COMMIT).parquet(f"{base}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def commit_tables(frames: dict[str, DataFrame], base: str, version: int, partition_by: dict[str, list[str]] | None = None) -> bool:
    """Writes several tables as one: each to a folder of this version, and last one row that names all of them.

    Readers go by that row, which comes in one file with its job, so they see all tables of a version or none. A version
    that broke off is written anew over what it left; one that is committed stays as it is, so that a batch that runs
    again adds nothing (``foreachBatch`` hands its number on). ``partition_by``: columns by which a table is laid out.
    Gives whether anything was committed. One writer at a time.
    """
    spark = next(iter(frames.values())).sparkSession
    if not _commits(spark, base).where(F.col("version") == version).isEmpty():
        return False
    paths = {name: f"{base}/{name}/v{version:012d}" for name in frames}
    for name, df in frames.items():
        writer = df.write.mode("overwrite")
        columns = (partition_by or {}).get(name)
        (writer.partitionBy(*columns) if columns else writer).parquet(paths[name])
    spark.createDataFrame([(version, paths)], COMMIT).coalesce(1).write.mode("append").parquet(f"{base}/commits")
    return True


def committed_tables(spark: SparkSession, base: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a committed version, the newest if none is said; none before the first commit."""
    rows = _commits(spark, base)
    rows = rows if version is None else rows.where(F.col("version") == version)
    newest = rows.agg(F.max_by("tables", "version").alias("tables")).first()["tables"]
    return {name: spark.read.parquet(path) for name, path in (newest or {}).items()}


def abandoned_folders(spark: SparkSession, base: str, names: list[str]) -> DataFrame:
    """(table, version) of folders that no commit names: what versions that broke off left behind."""
    kept = _commits(spark, base).select(F.explode("tables").alias("table", "path"))
    found = None
    for name in names:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{base}/{name}").select(F.lit(name).alias("table"), F.regexp_extract("path", r"/(v\d{12})/", 1).alias("v"))
        found = files if found is None else found.union(files)
    live = kept.select("table", F.regexp_extract("path", r"(v\d{12})$", 1).alias("v"))
    return found.distinct().join(live, ["table", "v"], "left_anti").select("table", F.substring("v", 2, 12).cast("long").alias("version"))
