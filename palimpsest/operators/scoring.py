"""A caller's scorer (a reranker, a judge) run over rows in bounded batches, so that no row is lost to a failure.

The scorer takes a list of texts or pairs and gives a number or null for each. A batch that fails, or that gives the wrong
number of answers, is halved until the rows that fail stand alone; the rest of it is scored. Every row says what
became of it, so rankings made with and without a scorer can be told apart.

Defined results: without a scorer every row is ``passed``; null answers are ``passed``; NaN and infinite answers are
``failed``, as are rows whose scoring raises; empty tables give no rows; rows come back once each, whatever repeats.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

Scorer = Callable[[list], Sequence[float | None]]
SCORED, PASSED, FAILED = "scored", "passed", "failed"


def answers(scorer: Scorer, items: list) -> list[tuple[float | None, str, str | None]]:
    """(score, state, message) of each item, in order; a failing batch is halved."""
    try:
        got = list(scorer(items))
        if len(got) != len(items):
            raise ValueError(f"{len(got)} answers for {len(items)} rows")
        got = [None if g is None else float(g) for g in got]
    except Exception as error:  # whatever a caller's function may raise
        if len(items) == 1:
            return [(None, FAILED, f"{type(error).__name__}: {error}"[:500])]
        half = len(items) // 2
        return answers(scorer, items[:half]) + answers(scorer, items[half:])
    return [(None, PASSED, None) if g is None else (g, SCORED, None) if math.isfinite(g) else (None, FAILED, f"score {g}") for g in got]


def _scoring(at: list[int], scorer: Scorer | None, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with their answers; only ``size`` rows at a time are Python's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[float | None, str, str | None]] = []
            for a in range(0, batch.num_rows, size):
                values = [batch.column(i).slice(a, size).to_pylist() for i in at]
                part = values[0] if len(at) == 1 else list(zip(*values))
                found += [(None, PASSED, None)] * len(part) if scorer is None else answers(scorer, part)
            extra = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.float64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "score", "state", "message"])

    return run


def scored(rows: DataFrame, columns: list[str], scorer: Scorer | None, size: int = 32) -> DataFrame:
    """``rows`` with ``score``, ``state`` and ``message``; the scorer gets lists of up to ``size`` values of the one column, or
    of tuples of several. Rows stay in their partitions and in their order."""
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType()), StructField("state", StringType()), StructField("message", StringType())])
    at = [rows.columns.index(c) for c in columns]
    return rows.mapInArrow(_scoring(at, scorer, size), schema)


def reranked(ranking: DataFrame, columns: list[str], scorer: Scorer | None, k: int, size: int = 32) -> DataFrame:
    """(…, score, state, message, rnk) of the ``k`` best of each query: scored rows by score, then the others, each in the
    order of the ranking (query, doc, rnk, columns); so a ranking nothing was scored of stays as it was."""
    rows = scored(ranking.withColumnRenamed("rnk", "before"), columns, scorer, size)
    order = Window.partitionBy("query").orderBy(F.desc_nulls_last("score"), "before")
    return rows.withColumn("rnk", F.row_number().over(order).cast("long")).where(F.col("rnk") <= k)
