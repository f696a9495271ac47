from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lamina.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    """(doc_id, lang, leaf, subroot, root, proof, folded, verified) with trees built level by level in memory."""
    leaf = lambda r, text: h(*map(field, (r[0], r[3], r[2], r[4], text)))
    made = sorted(((r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf(r, r[1]), r) for r in rows), key=lambda x: x[:5])
    langs = sorted({x[:2] for x in made})
    trees = {at: levels([x[4] for x in made if x[:2] == at]) for at in langs}
    above = levels([trees[at][-1][0] for at in langs])
    out = []
    for at in langs:
        for k, x in enumerate([x for x in made if x[:2] == at]):
            r = x[5]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now, proof = leaf(r, lower(r[1]) if hit else r[1]), []
            for tree, i in ((trees[at], k), (above, langs.index(at))):
                for row in tree[:-1]:
                    group, place = row[i // 8 * 8 : i // 8 * 8 + 8], i % 8
                    proof += group[:place] + group[place + 1 :]
                    now, i = h(*group[:place], now, *group[place + 1 :]), i // 8
            out.append((r[0], r[2], x[4], trees[at][-1][0], above[-1][0], h(*proof), now, now == above[-1][0]))
    return sorted(out, key=str)


def found(docs):
    return sorted(map(tuple, merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0).collect()), key=str)


@pytest.fixture
def low(monkeypatch):
    """Runs of eight leaves, so that small tables take several rounds."""
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    monkeypatch.setattr(merkle, "RUN", 8)
    monkeypatch.setattr(merkle, "RANGE", 50)


def rows_of(n, langs=("en", "de", None)):
    return [(k * 7 % n, f"Text {k} Äß {'Ab' * (k % 5)}", langs[0 if k % 3 else k % len(langs)], f"s{k % 4}", k) for k in range(n)]


@pytest.mark.parametrize("n", [1, 70, 700])
def test_same_as_trees_in_memory(spark, low, n):
    rows = rows_of(n, ("en", "de", None, "fr"))
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_whole_runs(spark):
    rows = [(k, f"Text {k}", "en", "a", k) for k in range(4_100)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_messy_clashing_and_empty(messy, clashing, empty):
    rows = [tuple(r) for r in messy.collect()]
    assert found(messy) == brute(rows)
    assert found(clashing) == found(messy)
    assert found(empty) == []


def test_one_row_with_a_third_of_all_copies(spark, low):
    rows = [(5, "One Text", "en", "a", 1)] * 120 + [(None, "Other", None, None, None)] * 60 + rows_of(90)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)


def test_log_is_in_postorder_and_holds_every_sibling(spark, monkeypatch):
    for height in (1, 2):
        monkeypatch.setattr(merkle, "HEIGHT", height)
        monkeypatch.setattr(merkle, "RUN", 8**height)
        sizes = {"a": 1, "b": 8, "c": 9, "d": 73, "e": 513, "f": 600}
        rows = [(lang, k, n, h(lang, str(k))) for lang, n in sizes.items() for k in range(n)]
        leaves = spark.createDataFrame(rows, "lang string, idx long, leaves long, digest string")
        kept = {}
        for r in merkle.log(merkle.build(leaves, ["lang"]), ["lang"]).collect():
            kept.setdefault(r["lang"], {})[r["position"]] = (r["level"], r["digest"])
        for lang, n in sizes.items():
            tree = levels([h(lang, str(k)) for k in range(n)])

            def postorder(level, k, tree=tree):
                if level:
                    for j in range(k * 8, min(k * 8 + 8, len(tree[level - 1]))):
                        yield from postorder(level - 1, j)
                yield level, tree[level][k]

            assert [kept[lang][p] for p in range(len(kept[lang]))] == list(postorder(len(tree) - 1, 0))
        asked = spark.createDataFrame([(level, k, n) for n in (73, 600) for level, row in enumerate(levels(["x"] * n)[:-1]) for k in range(len(row))], "level int, k long, n long")
        for r in asked.select("*", merkle.siblings(F.col("level"), F.col("k"), F.col("n")).alias("s")).collect():
            lang = {73: "d", 600: "f"}[r["n"]]
            row = levels([h(lang, str(k)) for k in range(r["n"])])[r["level"]]
            first = r["k"] // 8 * 8
            assert [kept[lang][p][1] for p in r["s"]["left"]] == row[first : r["k"]]
            assert [kept[lang][p][1] for p in r["s"]["right"]] == row[r["k"] + 1 : first + 8]
