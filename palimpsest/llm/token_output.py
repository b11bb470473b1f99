"""Token ids in Parquet: list columns with dictionary or delta encoding, small row groups, page indexes.

Documents are put in ascending id order by a range partitioning, encoded in Arrow batches, and written by Spark.
Ids repeat, so the token column is dictionary-encoded; doc ids and counts rise or vary little, so they use delta
encoding (format version 2). Row groups and pages are small enough that readers select documents by id through
the page index, and read metadata without touching tokens.

A text of ASCII and Latin letters up to U+023F alone is lower-cased and cut into the tokenizer's pieces as bytes; any other
text is cut at ASCII white space, where the tokenizer always cuts. Every distinct piece or chunk is encoded once per
task by the tokenizer's own model; chunks with special strings or letters beyond U+024F take the whole
tokenizer. The cache is cleared at a fixed number of entries. A file whose normalizers or pre-tokenizers are others
than that rests on takes the whole tokenizer for every text.

Defined results: a null text is empty and has the end id alone; null ids come first; equal ids are ordered by
text; an empty table writes and gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, trimmed

#: Chunks and words that a worker keeps, together.
CACHE_ENTRIES = 240_000
#: Marks after a word that are a piece of their own.
_ENDS = b".,;:!?"
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 64 << 10
#: Texts that move to a worker at once.
BATCH_ROWS = 512
#: The tokenizer's own pre-tokenization, on text already in lower case.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same on lower-cased UTF-8 that holds no letter but a-z and those beyond ASCII.
_BYTE_PIECES = re.compile(rb"[a-z\x80-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9\x80-\xff]+")
#: Bytes of white space, of what ASCII prints, and of U+00C0 to U+023F; all there but the last three are letters, and
#: have a lower case of letters alone.
_PLAIN = bytes([*range(9, 14), *range(32, 127), *range(128, 192), *range(0xC3, 0xC9)])
_NOT_PLAIN = "<|".encode(), "×".encode(), "÷".encode(), "İ".encode()
#: What the shortcut by chunks takes for granted of a tokenizer's file; any other file takes the library's way.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
_encoders: dict[str, Callable[[str | bytes], bytes]] = {}
_kept: dict[str, tuple[dict, dict]] = {}


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _by_chunks(file: dict) -> bool:
    """Whether a text's ids are those of its chunks between ASCII white space, cut and spelled as ``_PIECES`` does."""
    steps = (file.get("normalizer") or {}).get("normalizers"), (file.get("pre_tokenizer") or {}).get("pretokenizers")
    plain = not file.get("truncation") and not file.get("post_processor") and file["model"]["type"] == "BPE" and not file["model"].get("dropout")
    return plain and steps == (_NORMALIZERS, _PRE_TOKENIZERS) and all(t["content"].startswith("<|") for t in file["added_tokens"])


def _settings(whole) -> dict:
    """A tokenizer's file but for its vocabulary, which as objects would be some 100 MB a worker."""
    state = lambda part: None if part is None else json.loads(part.__getstate__())
    model = {"type": type(whole.model).__name__, "dropout": getattr(whole.model, "dropout", None)}
    added = [{"content": t.content} for t in whole.get_added_tokens_decoder().values()]
    return {"normalizer": state(whole.normalizer), "pre_tokenizer": state(whole.pre_tokenizer), "post_processor": state(whole.post_processor), "truncation": whole.truncation, "model": model, "added_tokens": added}


def text_encoder(path: str) -> Callable[[str | bytes], bytes]:
    """A function from text, or its UTF-8, to its ids as little-endian 32-bit integers; one per worker and file."""
    if path in _encoders:
        return _encoders[path]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    if not _by_chunks(_settings(whole)):
        _encoders[path] = lambda text: np.array(whole.encode(text if isinstance(text, str) else text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return _encoders[path]
    model, letters = whole.model, _byte_letters()
    ascii_letters = all(letters[b] == chr(b) for b in range(33, 127))
    assert ascii_letters
    words: dict[str, bytes] = {}
    tokenize, id_of, packers = model.tokenize, attrgetter("id"), [struct.Struct(f"<{n}I").pack for n in range(64)]

    def model_ids(spelled: str) -> bytes:
        ids = [*map(id_of, tokenize(spelled))]
        return packers[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()

    def word_ids(word: str) -> bytes:
        if word.isascii() and word.isalpha():  # the same word stands alone elsewhere, and is kept there
            return chunks[word.encode()]
        spelled = word if word.isascii() else "".join([letters[b] for b in word.encode()])
        words[word] = ids = model_ids(spelled)
        return ids

    def chunk_ids(raw: bytes) -> bytes:
        if raw.isalpha():  # ASCII letters alone: one word, kept once under its lower case
            return chunks[raw.lower()]
        if raw[-1] in _ENDS and raw[:-1].isalpha():
            return chunks[raw[:-1].lower()] + chunks[raw[-1:]]
        chunk = raw.decode()
        if "<|" in chunk or not chunk.isascii() and max(chunk) > "ɏ" or not chunk.isprintable():
            return np.array(whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
            low = chunk.lower()
            if low.isalpha():  # one word as well
                key = low.encode()
                return model_ids(key.decode("latin-1").translate(letters)) if key == raw else chunks[key]
        return b"".join([words.get(w) or word_ids(w) for w in _PIECES.findall(chunk.lower())])

    class Chunks(dict):
        def __missing__(self, raw: bytes) -> bytes:
            self[raw] = ids = model_ids(raw.decode()) if raw.isalpha() and raw.islower() else chunk_ids(raw)
            return ids

    chunks = Chunks()
    ids_of = chunks.__getitem__

    def encode(text: str | bytes) -> bytes:
        if len(chunks) + len(words) > CACHE_ENTRIES:
            chunks.clear()
            words.clear()
        raw = text if isinstance(text, bytes) else text.encode()
        if not raw.translate(None, _PLAIN) and not any(x in raw for x in _NOT_PLAIN):
            low = raw.lower() if raw.isascii() else raw.decode().lower().encode()
            return b"".join(map(ids_of, _BYTE_PIECES.findall(low)))
        return b"".join(map(ids_of, raw.split()))  # at ASCII white space alone

    _encoders[path] = encode
    _kept[path] = chunks, words
    return encode


def forget_words(path: str) -> None:
    """Empties what a worker keeps of words: it lives on through stages that have no use for them."""
    for kept in _kept.get(path, ()):
        kept.clear()


def _batches(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = text_encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encode(t or b"") + end for t in part.column(1).cast(pa.binary()).to_pylist()]
                counts = np.array([len(x) // 4 for x in ids], np.int32)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts.astype(np.int64)), tokens], ["doc_id", "n_tokens", "token_ids"])
        forget_words(path)

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, *, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Writes doc_id, n_tokens and token_ids to ``path``, in ascending id order over files and within them."""
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    tokens = ordered.mapInArrow(trimmed(_batches(vocabulary, end_id)), "doc_id long, n_tokens long, token_ids array<int>")
    options = {
        "compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES,
        "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#n_tokens": "false",
    }
    rows_at_once = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows_at_once)
    spark.conf.set(rows_at_once, str(BATCH_ROWS))  # texts move to workers in small batches: both sides hold a batch whole
    try:
        tokens.write.options(**options).parquet(path)
    finally:
        spark.conf.set(rows_at_once, before)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens, from metadata columns alone: ``start`` is where the document begins in the whole token stream."""
    return _with_start(spark.read.parquet(path).select("doc_id", "n_tokens", *_place()), path)


def _place():
    return F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")


def _with_start(rows: DataFrame, path: str) -> DataFrame:
    """File names rise with ids, and rows within files; totals of files, from their counts alone, make the starts of files."""
    earlier = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.sparkSession.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), "n_tokens")
    files = counts.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(files, "file").withColumn("start", F.col("start") + F.col("first")).drop("first", "file", "row")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        ends = lists.offsets.to_numpy()
        crc = [zlib.crc32(memoryview(ids[a:b])) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["file", "row", "doc_id", "n_tokens", "ids_crc32"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    rows = spark.read.parquet(path).select(*_place(), "doc_id", "token_ids")
    return _with_start(rows.mapInArrow(trimmed(_checksums), "file string, row long, doc_id long, n_tokens long, ids_crc32 long"), path)


def tokens_to_parquet(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Writes ``docs`` to a new folder of the shared directory and gives the digest read back from it."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, end_id)
    return token_digest(docs.sparkSession, path)
