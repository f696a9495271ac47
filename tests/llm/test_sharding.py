from __future__ import annotations

import hashlib
import zlib
from collections import Counter

from pyspark.sql import functions as F

from lamina.llm import sharding


def offset(source, seed):
    name = "n" if source is None else f"s:{source}"
    return int(hashlib.md5(f"{seed}/{name}".encode()).hexdigest()[:13], 16) / 16**13


def brute(rows, shards=24, seed=17):
    """Plain sorting of all rows in one place."""
    keyed = []
    for r in rows:
        raw = (r.text or "").encode()
        draw = hashlib.md5(f"{seed}:{'null' if r.doc_id is None else r.doc_id}:{len(raw) + 8}:{zlib.crc32(raw)}".encode()).hexdigest()[:13]
        keyed.append((r.source, draw, r.doc_id, len(raw) + 8, zlib.crc32(raw)))
    last = lambda x: (x is None, x if x is not None else 0)
    name = lambda x: (x is None, x or "")
    keyed.sort(key=lambda k: (name(k[0]), k[1], last(k[2]), k[3], k[4]))
    counts, seen, line = Counter(k[0] for k in keyed), Counter(), []
    for k in keyed:
        seen[k[0]] += 1
        line.append(((seen[k[0]] - offset(k[0], seed)) / counts[k[0]], name(k[0]), k[1], last(k[2]), k[3], k[4], k))
    line.sort(key=lambda x: x[:6])
    n = len(line)
    out = []
    for i, x in enumerate(line):
        shard = i * shards // n
        out.append((x[6][2], x[6][0], x[6][3], x[6][4], shard, i - -(-shard * n // shards)))
    return sorted(out, key=str)


def check(df, **options):
    got = sorted(map(tuple, sharding.stratified_shards(df, **options).collect()), key=str)
    assert got == brute(df.select("doc_id", "text", "source").collect())
    sizes = Counter(g[4] for g in got)
    assert not got or max(sizes.values()) - min(sizes.values()) <= 1 or len(got) < 24
    for s, n in sizes.items():
        assert sorted(g[5] for g in got if g[4] == s) == list(range(n))


def test_documents(documents):
    check(documents)


def test_hot_source_and_small_buckets(documents):
    check(documents.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source"))), bucket_rows=1)


def test_messy_rows_and_clashing_columns(messy, clashing, empty):
    check(messy)
    check(clashing)
    assert sharding.stratified_shards(empty).collect() == []


def test_each_shard_matches_the_mixture(documents):
    rows = sharding.stratified_shards(documents, shards=4).collect()
    whole, n = Counter(r.source for r in rows), len(rows)
    for s in range(4):
        part = Counter(r.source for r in rows if r.shard == s)
        assert all(abs(part[k] - whole[k] / 4) <= 2 for k in whole), (s, n)


def test_sources_of_one_row_are_spread(spark):
    rows = [(k, f"text {k}", "big" if k % 2 else f"small {k}") for k in range(2400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(df, bucket_rows=50)
    small = Counter(r.shard for r in sharding.stratified_shards(df).collect() if r.source != "big")
    assert len(small) == 24 and min(small.values()) >= 25 and max(small.values()) <= 80


def test_many_rows_without_an_id_and_with_equal_texts(spark):
    rows = [(None, "the same", "a")] * 500 + [(None, f"text {k % 7}", "b") for k in range(300)] + [(5, "copies", None)] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(df, bucket_rows=16)
    check(df)


def test_different_texts_without_an_id_or_with_one_are_spread(spark):
    for doc_id in (None, 7):
        df = spark.range(50_000).select(F.lit(doc_id).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("a").alias("source"))
        keys = sharding.keyed(df)
        bucket = F.floor(F.col("draw") * 64)
        assert keys.select("draw").distinct().count() > 49_900
        assert keys.groupBy(bucket).count().agg(F.max("count")).first()[0] < 2 * 50_000 / 64
    check(df.limit(3_000), bucket_rows=100)
