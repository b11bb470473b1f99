import zlib
from collections import defaultdict

from palimpsest.llm import kd_shards
from palimpsest.llm.queries import op8_kd_shards


def test_shards(docs, doc_rows, clashing):
    got = kd_shards.shard_documents(clashing, 16).collect()
    texts = {r[0]: r[1] or "" for r in doc_rows}
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in doc_rows)
    weight, slots, of_text = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        weight[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        of_text[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in of_text.values())
    assert set(weight) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sizes_are_near_equal(spark):
    rows = [(i, f"{i * 7919 % 1000003} " * (1 + i % 90)) for i in range(6000)]
    got = kd_shards.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 16).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 16 and max(sizes) < 1.02 * min(sizes)


def test_heavy_text_has_a_shard_of_its_own(spark):
    rows = [(i, "copy " * 50) for i in range(500)] + [(1000 + i, f"text {i} " * 30) for i in range(900)]
    got = kd_shards.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    heavy = {r["shard"] for r in got if r["doc_id"] < 1000}
    rest = defaultdict(int)
    for r in got:
        if r["doc_id"] >= 1000:
            rest[r["shard"]] += r["size"]
    assert len(heavy) == 1 and len(rest) == 7 and not heavy & set(rest) and max(rest.values()) < 1.1 * min(rest.values())


def test_few_rows(spark, empty):
    assert kd_shards.shard_documents(empty, 16).count() == 0
    one = spark.createDataFrame([(None, None), (None, None), (1, "a")], "doc_id long, text string")
    assert kd_shards.shard_documents(one, 16).count() == 3


def test_query(spark):
    got = op8_kd_shards(spark, "/root/testdata/sf0.001")
    assert got.where("law = 'bytes' and grown_shard is null and shard between 0 and 15").count() == 200
