"""Helpers shared by the training-data operators: durable lineage cuts and byte-exact text expressions."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: White space of the contracts: U+0020 and U+0009 to U+000D.
NON_SPACE_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, which is also where checkpoints go from here on."""
    context = spark.sparkContext
    folder = shared_folder(spark)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed reliably, so that a lost executor re-reads shared files instead of recomputing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_memory_back() -> None:
    """Frees what a Python worker holds and does not use: it waits for the next stage with what it has."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which its worker gives free memory back."""

    def all_then_trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_memory_back()

    return all_then_trim


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other code point as it is. Texts of ASCII alone take the faster ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids fall on the crc of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus

#: What separates words of the contracts: ASCII but for digits and letters; every code point beyond ASCII is a letter.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """The lower-cased words of a text; none for a null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: inside, it is an element of a one-element array.

    Arrays stay plain objects there, so that ``slice`` copies what it gives and not the whole array.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
