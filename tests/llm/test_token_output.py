import zlib

import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from palimpsest.llm import token_output
from palimpsest.llm.common import fresh_path
from palimpsest.llm.queries import vocabulary_path


def expected(rows):
    tok = Tokenizer.from_file(vocabulary_path())
    out, start = [], 0
    for doc_id, text in sorted(((r[0], r[1] or "") for r in rows)):
        ids = [*tok.encode(text, add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_digest_and_files(spark, docs, doc_rows, clashing):
    path = fresh_path(spark, "tokens")
    token_output.write_tokens(clashing, path, vocabulary_path(), 2)
    got = token_output.token_digest(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    want = expected(doc_rows)
    assert sorted(map(tuple, got)) == want
    index = token_output.read_index(spark, path).select("doc_id", "start", "n_tokens").collect()
    assert sorted(map(tuple, index)) == [w[:3] for w in want]


def test_encodings(spark, docs):
    path = fresh_path(spark, "tokens")
    token_output.write_tokens(docs.repartition(2), path, vocabulary_path(), 2)
    import glob

    meta = pq.ParquetFile(sorted(glob.glob(f"{path.removeprefix('file:')}/part-*"))[0]).metadata.row_group(0)
    columns = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    tokens = next(c for p, c in columns.items() if p.startswith("token_ids"))
    assert any("DICTIONARY" in e for e in tokens.encodings)
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert tokens.has_offset_index and columns["doc_id"].has_column_index


def test_encoder_equals_whole_tokenizer(doc_rows):
    tok, encode = Tokenizer.from_file(vocabulary_path()), token_output.text_encoder(vocabulary_path())
    more = ["", "İstanbul ǅ   x　y", "<|startoftext|>a<|endoftext|>", "a'LL b'D '''s", "Ångstrom å", "\x85 \x1f\x00", "x" * 3000, "12 345 ½ ١", "ʼn ŉ 힣 \U0001f600"]
    for text in [r[1] for r in doc_rows if r[1]] + more:
        assert np.frombuffer(encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_empty(spark, empty):
    path = fresh_path(spark, "tokens")
    token_output.write_tokens(empty, path, vocabulary_path(), 2)
    assert token_output.token_digest(spark, path).count() == 0


def test_other_tokenizers_take_the_librarys_way(doc_rows):
    from tokenizers import Tokenizer

    from palimpsest.llm.queries import vocabulary_path

    path = vocabulary_path("byte_bpe_50k.json")
    whole, encode = Tokenizer.from_file(path), token_output.text_encoder(path)
    for text in ("two  blanks\n and Capitals", "don't", *[r[1] or "" for r in doc_rows[:20]]):
        assert encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes() == encode(text.encode())


def test_the_shortcut_is_taken_for_its_own_file():
    import json

    from palimpsest.llm.queries import vocabulary_path

    assert token_output._by_chunks(json.load(open(vocabulary_path())))


def test_a_word_is_encoded_once_whatever_mark_follows():
    token_output._encoders.pop(vocabulary_path(), None)
    encode = token_output.text_encoder(vocabulary_path())
    whole = Tokenizer.from_file(vocabulary_path())
    for text in ["thonre, Thonre. thonre", "(thonre) thonre's thonre!! 7thonre; é, Éa. thonre:x ,a a,b, 's. x' <|a|>. ..", ". , a. A,"]:
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    kept = dict(zip(encode.__code__.co_freevars, (c.cell_contents for c in encode.__closure__)))
    assert b"thonre" in kept["chunks"] and "thonre" not in kept["words"]


def test_plain_texts_are_cut_to_pieces_without_their_marks():
    token_output._encoders.pop(vocabulary_path(), None)
    encode = token_output.text_encoder(vocabulary_path())
    whole = Tokenizer.from_file(vocabulary_path())
    texts = ["Thonre&&& THONRE,&&& (thonre) l'été, Été.&&& don't DON'T '''s 'LL 12a3 a_b\x0ba\x0cb", "x × y÷z İa aİb", "á  é<|a|> É", "Ⱥb ȺȾ,é"]
    texts += [f"a{chr(i)}B {chr(i)}. '{chr(i)}s 1{chr(i)}{chr(i + 1)}" for i in range(1, 0x260)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
    token_output._encoders.pop(vocabulary_path())
    encode = token_output.text_encoder(vocabulary_path())
    encode("Thonre&&& THONRE,&&& thonre Été É.&&&")
    kept = dict(zip(encode.__code__.co_freevars, (c.cell_contents for c in encode.__closure__)))
    assert set(kept["chunks"]) == {x.encode() for x in ("thonre", "&&&", ",&&&", "été", "é", ".&&&")} and not any(map(str.isalpha, kept["words"]))


def test_a_worker_forgets_words_after_its_task():
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["thonre, a&&", None])], ["doc_id", "text"])
    run = token_output._batches(vocabulary_path(), 2)
    first, again = ([b.to_pylist() for b in run(iter([rows]))] for _ in range(2))
    encode = token_output.text_encoder(vocabulary_path())
    kept = dict(zip(encode.__code__.co_freevars, (c.cell_contents for c in encode.__closure__)))
    assert first == again and first[0][1]["token_ids"] == [2] and not kept["chunks"] and not kept["words"]
