"""Pack documents into token sequences by minimum bin slack.

Bins are planned on the histogram of piece lengths, which has at most
``capacity`` rows whatever the corpus size: each step finds, by subset-sum
dynamic programming on bitsets, the fullest feasible combination around the
longest length left, and takes as many such bins as the counts allow. Pieces
then find their bin from their rank among pieces of equal length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut, small_batches

CAPACITY = 1024
END_ID = 2
#: Pieces of one length are ranked in chunks of about so many.
CHUNK = 20_000
#: Fixed value: the pre-tokenization pattern of byte-level vocabularies, with possessive repeats.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Characters whose classes no Unicode version since the pattern's library changed; texts with others are encoded as a whole.
SETTLED = "[\u0000-\u0557\u0600-\u06ff\u0900-\u0bff\u0e00-\u0e7f\u1e00-\u208e\u20a0-\u2bff\u2e00-\u9fff\uac00-\ud7a3\uf900-\ufffd\U0001f000-\U0001faff]*+"
#: The same over Latin letters and common punctuation, with classes spelled out: Python's own engine is twice as fast on it.
LATIN = "\\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf"
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
LATIN_PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: Words whose ids a worker keeps, at most, and the longest one that it keeps.
KEPT_WORDS, LONGEST = 250_000, 40
#: Beyond half of them a word is kept when it is met so often again, counted by its hash in so many places.
AGAIN, MARKS = 2, 1 << 22


class Letters(dict):
    """The byte alphabet's spelling of characters, kept as they are met."""

    def __init__(self) -> None:
        super().__init__()
        # printable bytes stand for themselves, the others for code points from 256 on
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = {x: 256 + k for k, x in enumerate(x for x in range(256) if x not in printable)}
        self.bytes = [chr(others.get(x, x)) for x in range(256)]

    def __missing__(self, char: str) -> str:
        self[char] = spelled = "".join([self.bytes[x] for x in char.encode()])
        return spelled


class Known(dict):
    """Ids of words, as bytes: a word that is missing is asked of the model and kept, if it is short.

    Most different words of a text are met once only: when half of the room is taken, the rest is for those that come again.
    """

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.letters, self.tokenize = Letters(), tokenizer.model.tokenize
        self.space = self.letters[" "]
        self.met = bytearray(MARKS)
        self.spelled = [np.array([k], "<u4").tobytes() for k in range(tokenizer.get_vocab_size())]

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            letters = word.replace(" ", self.space)
        else:
            letters = "".join(map(self.letters.__getitem__, word))
        spelled = self.spelled
        ids = b"".join([spelled[t.id] for t in self.tokenize(letters)])
        if len(word) <= LONGEST and len(self) < KEPT_WORDS:
            mark = hash(word) % MARKS
            if len(self) < KEPT_WORDS // 2 or self.met[mark] >= AGAIN:
                self[word] = ids
            else:
                self.met[mark] += 1
        return ids


class Encoder:
    """Ids of texts by a tokenizers file, as its ``encode(text, add_special_tokens=False)`` gives them.

    Byte-level BPE encodes each pre-token on its own, so a word's ids are asked of
    the file's model once and kept. Other kinds of files, and texts with characters
    whose class may differ between Unicode versions, are encoded as a whole.
    """

    def __init__(self, path: str | None = None) -> None:
        import json

        import regex
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        first = parts.get("pre_tokenizer") or {}
        plain = first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)
        tokens = parts.get("added_tokens") or []
        simple = not any(t.get(k) for t in tokens for k in ("lstrip", "rstrip", "single_word"))
        self.by_word = plain and simple and not parts.get("normalizer") and parts["model"].get("type", "BPE") == "BPE"
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in tokens}
        self.parts = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words, self.settled = regex.compile(PATTERN).findall, regex.compile(SETTLED).fullmatch
        self.latin_words, self.latin = re.compile(LATIN_PATTERN).findall, re.compile(f"[{LATIN}]*").fullmatch
        self.known = Known(self.tokenizer)

    def _plain(self, text: str, words) -> bytes:
        return b"".join(map(self.known.__getitem__, words(text)))

    def raw(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        words = self.latin_words if self.latin(text) else self.words
        if not self.by_word or (words is self.words and self.settled(text) is None):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.parts is None or not any(x in text for x in self.added):
            return self._plain(text, words)
        out, at = [], 0
        for m in self.parts.finditer(text):
            out += (self._plain(text[at : m.start()], words), self.added[m[0]])
            at = m.end()
        return b"".join([*out, self._plain(text[at:], words)])

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.raw(text), "<u4")


def worker_encoder(path: str | None = None) -> Encoder:
    """The encoder of this Python worker, which serves many tasks: they share the words it has met."""
    import sys
    from types import ModuleType

    kept = sys.modules.setdefault("_lamina_worker", ModuleType("_lamina_worker")).__dict__.setdefault("encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(df: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])`` for each piece of each document.

    A document is the ids of its text and then ``end_id``. Null and empty texts
    have the end id alone. ``tokenizer`` is the path of a tokenizers file; strings of its
    added tokens in a text are those tokens.
    """
    small_batches(df.sparkSession)
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    fields = [("doc_id", source.schema["doc_id"].dataType), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType([T.StructField(n, t) for n, t in fields])

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = worker_encoder(tokenizer).raw, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            owner, rows = [], []
            for at, value in enumerate(batch.column("text")):
                ids = encode(value.as_py() or "") + end
                for k, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    owner.append(at)
                    rows.append((k, start, length, zlib.crc32(part), np.frombuffer(part, "<u4") if with_ids else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            arrays = [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:4])]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in columns[4]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(tokenize, schema)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """Numbers of each length whose sum is the largest within ``room``; lengths descending."""
    mask = (1 << (room + 1)) - 1
    reach, layers = 1, []
    for x in lengths:
        most = min(counts[x], room // x)
        if most <= 0:
            continue
        layers.append((x, reach))
        step = 1
        while most:
            take = min(step, most)
            reach |= (reach << (x * take)) & mask
            most -= take
            step *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for x, before in reversed(layers):
        while not before >> total & 1:
            total -= x
            chosen[x] = chosen.get(x, 0) + 1
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """``(number of bins, {length: pieces per bin})`` in order; uses up the histogram exactly."""
    if any(not 0 < x <= capacity for x in histogram):
        raise ValueError("lengths must lie in 1..capacity")
    left = {x: n for x, n in histogram.items() if n}
    plan = []
    while left:
        lengths = sorted(left, reverse=True)
        longest = lengths[0]
        left[longest] -= 1
        chosen = fullest(lengths, left, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[x] // k for x, k in chosen.items())
        for x, k in chosen.items():
            left[x] -= times * k
            if not left[x]:
                del left[x]
        plan.append((times, chosen))
    return plan


def pack(cuts: DataFrame, capacity: int = CAPACITY, chunk: int = CHUNK) -> DataFrame:
    """Add ``(sequence_id, offset)`` to pieces, whose ``length`` alone matters.

    The pieces (no texts, no ids) are written once to the shared scratch folder, with a number
    for each row, from which counting and placing read. Only the length histogram (at most
    ``capacity`` rows) comes to the driver and
    only the plan made of it is broadcast; its size depends on the capacity,
    not on the data. Ranks within a length are counted in chunks hashed by row number, so a
    length that a third of all pieces have is spread over many tasks, whatever their ids. Repeated
    rows are separate pieces. No rows give no rows.
    """
    spark, columns = cuts.sparkSession, [F.col(f"`{c}`") for c in cuts.columns]
    cuts = cut(cuts.withColumn("__row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows, sequence, used = [], 0, dict.fromkeys(histogram, 0)
    for times, chosen in plan_bins(histogram, capacity):
        offset = 0
        for x in sorted(chosen, reverse=True):
            k = chosen[x]
            rows.append((x, used[x], used[x] + times * k, k, sequence, offset))
            used[x] += times * k
            offset += k * x
        sequence += times
    plan = spark.createDataFrame(rows, "p_length long, lo long, hi long, k long, base long, off long")
    chunks = max(64, sum(histogram.values()) // chunk)
    dealt = cuts.withColumn("__chunk", F.pmod(F.xxhash64("__row"), F.lit(chunks)))
    sizes = dealt.groupBy("length", "__chunk").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("length").orderBy("__chunk")) - F.col("size")
    begins = sizes.select("length", "__chunk", before.alias("__begin"))
    within = F.row_number().over(Window.partitionBy("length", "__chunk").orderBy("__row"))
    ranked = dealt.withColumn("__within", within).join(begins, ["length", "__chunk"]).withColumn("__rank", F.col("__begin") + F.col("__within") - 1)
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("p_length")) & (F.col("__rank") >= F.col("lo")) & (F.col("__rank") < F.col("hi")))
    nth = F.col("__rank") - F.col("lo")
    return placed.select(*columns, (F.col("base") + F.expr("(__rank - lo) div k")).alias("sequence_id"), (F.col("off") + F.pmod(nth, F.col("k")) * F.col("length")).alias("offset"))


def pack_documents(df: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Tokenize, cut and pack: one row per piece with its place in a sequence.

    Every text is tokenized once. Nulls, empty texts, repeated rows and extra columns as in :func:`pieces` and :func:`pack`.
    """
    return pack(pieces(df, text, doc_id, capacity, end_id, tokenizer), capacity)
