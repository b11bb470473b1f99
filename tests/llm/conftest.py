from __future__ import annotations

import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(table: str) -> list[dict]:
    return pq.read_table(f"{SF}/{table}.parquet").to_pylist()


#: Nulls in every column, empty, blank and one-word texts, ties and repeats, letters beyond ASCII, a very long text.
ODD = [
    (9001, None, None, None, None),
    (9002, "", "en", None, 0),
    (9003, "   \t\n", "en", "s1", 5),
    (9004, "one", "en", "s1", 3),
    (9005, "one", "en", "s2", 3),
    (9006, "ÉCOLE École école Straße ŻÓŁĆ 東京 tower block \x1c x", "fr", "é", 40),
    (9007, "don't STOP we're 3x7 <|endoftext|> 'tis été", "en", "S1", 40),
    (9008, "alpha beta gamma delta " * 4000, "en", "s1", 92000),
    (9009, "alpha beta gamma delta " * 4000, "en", "s1", 92000),
    (9010, "a b c d e f g h i j k l m n o p", "en", "s3", 31),
]


@pytest.fixture(scope="session")
def doc_rows():
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows_of("documents")]
    return rows + ODD


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns named like those the operators make."""
    from pyspark.sql import functions as F

    names = ["size", "source_size", "target", "taken", "copies", "u", "x", "bucket", "rho", "mark", "component_id", "shard", "slot", "tie", "start", "n_tokens", "token_ids", "words", "pos", "item_id", "score", "label", "h", "file", "row", "node", "level", "doc", "_hash", "_id", "_score", "text_hash", "_bad", "_nth", "_spans", "row_id", "row_hash", "bad_id", "bad_hash", "spans", "hash", "id", "n"]
    return docs.withColumns({n: F.lit("clash") for n in names})
