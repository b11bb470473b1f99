"""Scans over landed files. Fetching is outside the engine; what a fetcher lands is read here, checked and kept apart if broken."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw, record, broken): one JSON document a file, as a variant; unreadable ones stay, marked."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    record = F.try_parse_json("raw")
    return files.withColumn("record", record).withColumn("broken", F.col("record").isNull())


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def attachments(spark: SparkSession, path: str, least: int = 1024) -> DataFrame:
    """(path, name, size, sha256, valid) of the binary files of one folder, not below it; tiny files are failed downloads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), (F.col("length") >= least).alias("valid"))


def sheet_rows(spark: SparkSession, path: str, columns: list[str], key: str, skip: int = 1) -> DataFrame:
    """A sheet exported as CSV, columns by place: the first ``skip`` rows of each file go, then rows whose key is no number."""
    rows = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    if skip:
        place = Window.partitionBy("_file", "_from").orderBy("_at")
        rows = rows.withColumns({"_file": F.col("_metadata.file_path"), "_from": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
        rows = rows.withColumn("_n", F.row_number().over(place)).where((F.col("_from") > 0) | (F.col("_n") > skip))
    return rows.where(F.col(key).rlike(r"^\d+$")).select(*columns)


def whole_pages(pages: DataFrame, html: str = "html", tail: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Pages that came whole, and those that were cut off."""
    whole = F.coalesce(F.contains(F.lower(F.substring(F.col(html), -tail, tail)), F.lit("</html>")), F.lit(False))
    return pages.where(whole), pages.where(~whole)


def tree_links(pages: DataFrame, html: str = "html", call: str = "gotoLawList") -> DataFrame:
    """(…, title, seq, history_seq) of each scripted link of three arguments or more: the third is the title, the first the
    number, the last that of the history, or the one before it where the last is empty."""
    args = F.explode(F.regexp_extract_all(html, F.lit(rf"{call}\(([^)]*)\)"), F.lit(1))).alias("args")
    rows = pages.select(*[c for c in pages.columns if c != html], args)
    rows = rows.withColumn("args", F.transform(F.split("args", ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]+|['\"]+$", ""))).where(F.size("args") >= 3)
    last = F.when(F.element_at("args", -1) == "", F.element_at("args", -2)).otherwise(F.element_at("args", -1))
    return rows.select("*", F.get("args", 2).alias("title"), F.get("args", 0).alias("seq"), last.alias("history_seq")).drop("args")


def history_numbers(pages: DataFrame, page: str, html: str = "html", call: str = "goHistory") -> DataFrame:
    """(page, seq): the distinct numbers of scripted history links, to be ordered as numbers, newest first."""
    found = F.explode(F.regexp_extract_all(html, F.lit(rf"{call}\('?(\d+)'?\)"), F.lit(1))).alias("seq")
    return pages.select(page, found).select(page, F.col("seq").cast("long").alias("seq")).distinct()


def newest_attachment(posts: DataFrame, board: str, order: str, name: str, extension: str, parts: list[str], size: str, least: int = 1024) -> DataFrame:
    """Of each board the newest post whose file has the extension and all ``parts`` in its name; tiny files are failures."""
    fits = F.endswith(F.lower(name), F.lit(extension.lower())) & (F.col(size) >= least)
    for part in parts:
        fits &= F.contains(name, F.lit(part))
    return posts.where(fits).groupBy(board).agg(F.max_by(F.struct(*[c for c in posts.columns if c != board]), order).alias("_p")).select(board, "_p.*")


def manifest_mismatch(files: DataFrame, manifest: DataFrame, key: str = "name") -> DataFrame:
    """Files of the manifest that are missing or of another size."""
    want = manifest.select(key, F.col("size").alias("want"))
    have = files.select(key, F.col("size").alias("got"))
    return want.join(have, key, "left").where(F.col("got").isNull() | (F.col("got") != F.col("want")))
