from __future__ import annotations

import random

import xxhash
from pyspark.sql import functions as F

from lamina.llm import simhash
from lamina.llm.components import components
from lamina.llm.frames import sized


def brute_fingerprint(text):
    words, cur = [], ""
    for ch in (text or "") + " ":
        if ch in " \t\n\x0b\x0c\r":
            words += [cur] if cur else []
            cur = ""
        else:
            cur += ch.lower() if "A" <= ch <= "Z" else ch
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest reachable id by row; prints: list of (id, fingerprint)."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    smallest = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            smallest[find(k)] = min(smallest.get(find(k), i), i)
    return [smallest.get(find(k)) for k in range(len(prints))]


def check(df):
    rows = df.select("doc_id", "text").collect()
    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(prints, brute_components(prints), strict=True)), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str) == want


def test_documents(documents):
    check(documents)


def test_messy_rows_and_clashing_columns(messy, clashing):
    check(messy)
    check(clashing)


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).collect() == []


def chains(spark):
    """Fingerprints in chains of two-bit steps, and far ones."""
    draw, fps = random.Random(5), set()
    for _ in range(20):
        f = draw.getrandbits(64)
        for _ in range(draw.randint(1, 12)):
            fps.add(f)
            for _ in range(draw.choice([1, 2, 3])):
                f ^= 1 << draw.randrange(64)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    return sorted(fps), spark.createDataFrame([(f,) for f in signed], "fp long")


def check_links(spark, crowded):
    fps, df = chains(spark)
    found = components(simhash.links(df, crowded)).collect()
    unsigned = lambda x: x & (1 << 64) - 1
    groups = {}
    for r in found:
        groups.setdefault(r.root, set()).add(unsigned(r.node))
    want = {}
    for f, c in zip(fps, brute_components([(k, f) for k, f in enumerate(fps)]), strict=True):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_lattice_join_loses_no_link(spark):
    check_links(spark, crowded=simhash.CROWDED)


def test_crowded_cells_give_the_same_components(spark):
    check_links(spark, crowded=1)


def test_embedding_is_a_lower_bound(spark):
    _, df = chains(spark)
    rows = df.select("fp", simhash.embedding_key(F.col("fp")).alias("k")).collect()
    for a in rows[:40]:
        for b in rows[:40]:
            apart = sum(abs((a.k >> 4 * i & 15) - (b.k >> 4 * i & 15)) for i in range(16))
            assert apart <= ((a.fp ^ b.fp) & (1 << 64) - 1).bit_count()


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (1, 0)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(found.values()) == {0, 100} and len(found) == 41 + 60


def test_no_join_of_exploded_rows_is_broadcast_by_estimate(spark):
    """Spark takes the 33 cells or 65 points of a fingerprint for one row: whether a side is sent to all is never left to that."""
    df = chains(spark)[1]
    plan = simhash.links(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    keys = spark.range(50).withColumnRenamed("id", "k")
    joined = lambda rows: df.withColumn("k", F.col("fp") % 50).join(sized(keys, rows), "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in joined(50) and "BroadcastExchange" not in joined(49)
