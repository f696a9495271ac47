from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import settings as hyp
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lamina.llm import packing, queries

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ENCODER = packing.Encoder()


def brute_pieces(text):
    ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]
    first = len(ids) % 1024 or 1024
    cuts = [0, *range(first, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
    return [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def check(rows, texts, slack=1.05):
    by_sequence, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    want = defaultdict(list)
    for doc_id, text in texts:
        want[doc_id] += brute_pieces(text)
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= slack * -(-total // 1024) + 1


def test_documents(documents):
    check(packing.pack_documents(documents).collect(), [tuple(r) for r in documents.select("doc_id", "text").collect()])


def test_messy_rows_and_clashing_columns(messy, clashing):
    texts = [tuple(r) for r in messy.select("doc_id", "text").collect()]
    check(packing.pack_documents(messy).collect(), texts)
    check(packing.pack_documents(clashing).collect(), texts)


def test_empty_table(empty):
    assert packing.pack_documents(empty).collect() == []


def test_special_token_strings_are_tokens(spark):
    df = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    assert packing.pieces(df, with_ids=True).first().ids == [64, 220, 50256, 275, 2]


@hyp(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["<|endoftext|>", " ", "  ", "\n", "\t", "\u00a0", "'s", "'ll", " don't", "x1", "é", "漢字", "🙂", "\u0558", "\u208f", "\U00010940", "\x1c", "\x85", "\u2028"])), max_size=20))
def test_words_encoded_one_by_one_give_the_ids_of_the_whole_text(parts):
    text = "".join(parts)
    assert ENCODER.ids(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_every_character_class():
    for c in range(0x3400):
        text = f"a{chr(c)}1 {chr(c)}{chr(c)} b {chr(c)}"
        assert ENCODER.ids(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids, hex(c)


def test_rows_without_an_id_are_spread(spark):
    df = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'same text' as text")
    rows = packing.pack_documents(df).collect()
    assert len(rows) == 3000 and len({(r.sequence_id, r.offset) for r in rows}) == 3000


def test_added_tokens_as_in_the_json(spark, tmp_path):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "  <|endoftext|>  ", "<|endoftext|", "plain", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in queries.op1_best_fit_packing(spark, str(tmp_path)).collect():
        ids = [*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), texts[r.doc_id]


@hyp(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=12))
def test_plan_uses_each_piece_once_and_never_overfills(histogram):
    used = defaultdict(int)
    for times, chosen in packing.plan_bins(histogram, 40):
        assert sum(x * k for x, k in chosen.items()) <= 40
        for x, k in chosen.items():
            used[x] += times * k
    assert used == histogram


def test_fullest_is_the_best_sum():
    from itertools import product

    lengths, counts = [9, 7, 4], {9: 2, 7: 3, 4: 2}
    for room in range(0, 40):
        best = max(s for ks in product(*(range(counts[x] + 1) for x in lengths)) if (s := sum(k * x for k, x in zip(ks, lengths, strict=True))) <= room)
        assert sum(x * k for x, k in packing.fullest(lengths, counts, room).items()) == best


def test_hot_length_is_ranked_in_chunks(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "0L as start", "if(id % 3 = 0, 1024L, 100L) as length", "1L as ids_crc32")
    rows = packing.pack(df, chunk=50).collect()
    assert len(rows) == 3000 and len({(r.sequence_id, r.offset) for r in rows}) == 3000
    assert len({r.sequence_id for r in rows}) == 1000 + 200


def test_words_that_come_again_are_kept(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 20)
    encoder = packing.Encoder()
    known = encoder.known
    first, often, once = [[f" {stem}{chr(97 + k)}" for k in range(n)] for stem, n in (("first", 10), ("often", 5), ("once", 26))]
    text = "".join(first + often * 3 + once)
    for _ in range(2):
        assert encoder.ids(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert set(known) == {*first, *often}
