from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from lamina.llm import mixing


def brute_probabilities(rows, rate, temper):
    held = defaultdict(float)
    for r in rows:
        held[r.source, r.lang, r.topic] += r.n_tokens
    total = sum(held.values())
    fitted = {k: v * rate for k, v in held.items()}
    for _ in range(500):
        before = dict(fitted)
        for d, name in enumerate(mixing.DIMENSIONS):
            share = defaultdict(float)
            for k, v in held.items():
                share[k[d]] += v / total
            raised = {k: v ** temper[name] for k, v in share.items()}
            want = {k: v / sum(raised.values()) * rate * total for k, v in raised.items()}
            now = defaultdict(float)
            for k, v in fitted.items():
                now[k[d]] += v
            fitted = {k: min(v * want[k[d]] / now[k[d]], held[k]) for k, v in fitted.items()}
        if max(abs(fitted[k] - before[k]) for k in held) <= 1e-9 * rate * total:
            break
    return {k: min(1.0, fitted[k] / held[k]) for k in held}


def check(df, **options):
    rows = mixing.mix(df, **options).collect()
    assert len(rows) == df.count()
    want = brute_probabilities(rows, mixing.RATE, mixing.TEMPER)
    cells = defaultdict(lambda: defaultdict(list))
    for r in rows:
        assert abs(r.probability - want[r.source, r.lang, r.topic]) < 1e-6
        tag = xxhash.xxh64_intdigest((r.text or "").encode(), 42)
        key = f"null:{tag - 2**64 if tag >= 2**63 else tag}" if r.doc_id is None else str(r.doc_id)
        u = int(hashlib.md5(f"11:{key}".encode()).hexdigest()[:13], 16) / 16**13
        cells[r.source, r.lang, r.topic][u].append(r)
    for draws in cells.values():
        held, before = sum(r.n_tokens for x in draws.values() for r in x), 0
        for u in sorted(draws):
            size = sum(r.n_tokens for r in draws[u])
            assert all(r.sampled == (before + size / 2 <= r.probability * held) for r in draws[u])
            before += size
        taken = sum(r.n_tokens for x in draws.values() for r in x if r.sampled)
        assert abs(taken - held * next(iter(draws.values()))[0].probability) <= max(sum(r.n_tokens for r in x) for x in draws.values()) / 2 + 1e-6


def test_documents(documents):
    check(documents)


def test_messy_rows_and_clashing_columns(messy, clashing, empty):
    check(messy)
    check(clashing)
    assert mixing.sample(clashing).columns == clashing.columns
    assert mixing.mix(empty).collect() == []


def test_raking_meets_feasible_marginals():
    held = np.array([50.0, 30.0, 10.0, 60.0])
    rows, cols = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    fitted = mixing.rake(held, [rows, cols], [np.array([0.5, 0.5]), np.array([0.4, 0.6])], 60.0)
    assert np.allclose(np.bincount(rows, fitted), [30, 30]) and np.allclose(np.bincount(cols, fitted), [24, 36])
    assert (fitted <= held).all()


def test_sampled_tokens_are_near_their_targets(documents):
    rows = mixing.mix(documents, {"lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}}, rate=0.3).collect()
    expected, sampled = defaultdict(float), defaultdict(float)
    for r in rows:
        expected[r.lang] += r.n_tokens * r.probability
        sampled[r.lang] += r.n_tokens * r.sampled
    total = sum(expected.values())
    assert abs(expected["en"] / total - 0.5) < 0.08
    cells = defaultdict(int)
    for r in rows:
        cells[r.lang, r.source, r.topic] = max(cells[r.lang, r.source, r.topic], r.n_tokens)
    for lang in expected:
        # each cell is off by half a document at most
        assert abs(sampled[lang] - expected[lang]) <= sum(n for (x, *_), n in cells.items() if x == lang) / 2


def test_tables_and_memory_rake_alike(spark):
    draw = np.random.default_rng(2)
    rows = [(f"s{a}" if a else None, f"l{b}", f"t{c}", int(draw.integers(1, 900))) for a in range(9) for b in range(4) for c in range(3) if (a + b + c) % 5]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, held long")
    for targets in (None, {"lang": {"l0": 0.4, "l1": 0.4, "l2": 0.2}}):
        here, there = (sorted(map(tuple, mixing.probabilities(cells, targets, in_memory=n, rounds=4).collect()), key=str) for n in (10_000, 1))
        assert [x[:3] for x in here] == [x[:3] for x in there] and all(abs(x[3] - y[3]) < 1e-6 for x, y in zip(here, there, strict=True))


def test_rows_without_an_id_draw_by_their_text(spark):
    df = spark.createDataFrame([(None, f"a text with the number {k}", "s", "en") for k in range(200)], "doc_id long, text string, source string, lang string")
    sampled = [r.sampled for r in mixing.mix(df, rate=0.5).collect()]
    assert 60 < sum(sampled) < 140


def test_topics_and_tokens_against_plain_versions(spark, documents):
    made = ["call +49 (30) 123456", "mail a.b@c.de", "a <|endoftext|> b", "wörter", " ", "", None]
    df = documents.select("doc_id", "text", "source", "lang").union(spark.createDataFrame([(-k, t, "a", "en") for k, t in enumerate(made, 1)], "doc_id long, text string, source string, lang string"))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    topics = mixing.fit_topics(df)
    seen = defaultdict(int)
    for r in mixing.mix(df).collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == max(1, len(ids))
        if not ids:
            assert r.topic == "empty"
            continue
        counts = Counter((i * 0x9E3779B97F4A7C15 % 2**64) >> 55 for i in ids)
        x = {p: math.log1p(n) * topics.weights[p] for p, n in counts.items()}
        size, mean = math.sqrt(sum(v * v for v in x.values())), topics.means.get(r.lang, topics.means[None])
        near = [sum(c * (x.get(p, 0.0) / size - m) for p, (c, m) in enumerate(zip(centre, mean, strict=True))) for centre in topics.centres]
        assert near[int(r.topic.removeprefix("topic_"))] >= max(near) - 1e-9
        seen[r.topic] += 1
    assert len(seen) >= 6


def test_clusters_part_unlike_texts():
    draw = np.random.default_rng(1)
    counts = np.zeros((300, mixing.PLACES))
    for k in range(300):
        counts[k, draw.integers(0, 100, 60) + 100 * (k % 3)] += 1
    # one id for each place
    ids = np.array(sorted({int(p): k for k, p in enumerate(mixing.places(np.arange(20_000)))}.values()))
    topics = mixing.cluster(counts, [None] * 300, 3)
    own = [topics.of(np.repeat(ids, x[mixing.places(ids)].astype(int))) for x in counts]
    assert all(own[k] == own[k % 3] for k in range(300)) and len(set(own)) == 3


def test_topics_are_fitted_on_all_texts(documents):
    topics = mixing.fit_topics(documents, limit=50)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    langs = {}
    for r in documents.collect():
        if r.text:
            langs[r.text] = min(langs.get(r.text, r.lang), r.lang)
    texts = list(langs)
    counts = np.zeros((len(texts), mixing.PLACES))
    for k, x in enumerate(texts):
        for i in t.encode(x, add_special_tokens=False).ids:
            counts[k, (i * 0x9E3779B97F4A7C15 % 2**64) >> 55] += 1
    assert len(texts) > 100
    assert np.allclose(topics.weights, np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))) + 0.1)
    x = np.log1p(counts) * topics.weights
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    for lang, mean in topics.means.items():
        assert np.allclose(mean, x[[lang is None or langs[v] == lang for v in texts]].mean(0))
    x = x - np.stack([topics.means[langs[v]] for v in texts])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    own = np.argmax(x @ topics.centres.T, 1)
    # centres are those of the texts that are nearest to them
    for k in np.unique(own):
        centre = x[own == k].sum(0)
        assert np.allclose(centre / np.sqrt(centre @ centre), topics.centres[k], atol=1e-6)


def test_counts_of_one_and_four_bytes():
    import pyarrow as pa

    rows = np.zeros((2, mixing.PLACES), int)
    rows[0, 3], rows[1, 4] = 255, 70_000
    cells = pa.array([mixing.packed(x) for x in rows], pa.binary())
    assert [len(x.as_py()) for x in cells] == [mixing.PLACES, 4 * mixing.PLACES]
    assert (mixing.unpacked(cells) == rows).all()


def test_a_round_reads_blocks_and_moves_centres_as_a_plain_one(spark):
    draw = np.random.default_rng(4)
    counts = draw.poisson(0.3, (150, mixing.PLACES))
    counts[::7, 5] = 300  # of four bytes
    langs = [(None, "en", "de", "xx")[k % 4] for k in range(len(counts))]
    rows = [(mixing.packed(x), v) for x, v in zip(counts, langs, strict=True)]
    weights, means = draw.random(mixing.PLACES) + 0.1, {None: draw.random(mixing.PLACES) / 90, "de": draw.random(mixing.PLACES) / 90, "en": draw.random(mixing.PLACES) / 90}
    centres = draw.normal(size=(6, mixing.PLACES))
    centres = np.concatenate([centres / np.sqrt((centres * centres).sum(1, keepdims=True)), np.full((1, mixing.PLACES), -1.0)])
    blocks = mixing._blocks(spark.createDataFrame(rows, "counts binary, lang string").coalesce(1), weights, means)
    assert blocks.count() <= len(rows) / mixing.BLOCK + 2 + 22 / (mixing.BLOCK / 4)
    got = mixing._moved(blocks, centres, weights, np.stack(list(means.values())))
    x = np.log1p(counts) * weights
    x = x / np.sqrt((x * x).sum(1, keepdims=True)) - np.stack([means.get(v, means[None]) for v in langs])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    own = np.argmax(x @ centres.T, 1)
    assert len(set(own)) > 2 and 6 not in own
    for k, centre in enumerate(centres):
        total = x[own == k].sum(0)
        # a centre without texts stays
        want = total / np.sqrt(total @ total) if (own == k).any() else centre
        assert np.allclose(got[k], want, atol=1e-12)
