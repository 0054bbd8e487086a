import zlib

from carelog.llm.sharding import shard


def check(rows, shards, spread):
    by = {}
    for r in rows:
        text = (r["text"] or "").encode()
        assert r["text_crc32"] == zlib.crc32(text) and r["size_"] == len(text) + 1
        by.setdefault(r["shard_"], []).append(r)
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    sizes = [sum(r["size_"] for r in by.get(s, [])) for s in range(shards)]
    assert set(by) <= set(range(shards)) and max(sizes) - min(sizes) <= spread, sizes


def test_equal_bytes_with_a_hot_text(spark):
    rows = [(i, "y" * 60 if i % 3 == 0 else f"text {i} " * (i % 7), 1, "a") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int, shard string")
    got = shard(docs, cell_rows=10).collect()
    assert len(got) == 900
    check(got, 8, 2 * 61 + 60)
    # equal texts lie together: only a splitter parts them
    hot = sorted((r["shard_"], r["slot"]) for r in got if r["doc_id"] % 3 == 0)
    assert all(b[0] != a[0] or b[1] == a[1] + 1 for a, b in zip(hot, hot[1:]))


def test_odd_rows(odd_docs, no_docs):
    got = shard(odd_docs, shards=3).collect()
    assert len(got) == odd_docs.count()
    check(got, 3, 10**9)
    assert shard(no_docs).count() == 0 and shard(odd_docs.limit(1)).count() == 1


def test_one_result_whatever_the_partitions(odd_docs):
    docs = odd_docs.where("doc_id <> 3")
    rows = lambda df: sorted((str(r["doc_id"]), r["shard_"], r["slot"]) for r in shard(df).collect())
    assert rows(docs) == rows(docs.repartition(5))
