"""Mix documents to target weights by iterative proportional fitting.

Token totals of source x language x topic cells are raked to the target
marginals, never beyond what a cell holds; documents are then sampled with the
calibrated probability of their cell, systematically: a cell's documents in the order of their draws, up to its share of
tokens, so cells meet their totals to within a document. Topics are clusters of hashed token
counts, fitted on all different texts; tokens are those of the packing vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut, drop, small_batches
from .frames import sized, text_tag, without
from .packing import worker_encoder

DIMENSIONS = ("source", "lang", "topic")
#: Share of all tokens to sample, and exponents that temper observed shares where no target is given.
RATE, TEMPER = 0.7, {"source": 0.7, "lang": 0.8, "topic": 1.0}
SEED = 11
#: Topics, the places that token ids are hashed to, and the texts that give the centres' starting points, at most.
TOPICS, PLACES, SAMPLE = 12, 512, 4_000
EMPTY = "empty"
#: Seeded runs over the texts of the starting points, of which the tightest is where the fit over all texts starts.
STARTS = 6
#: Rounds over all texts, at most; they end before if no centre moves.
SWEEPS = 40
#: Texts of one row of the table that the rounds read.
BLOCK = 32
#: Parts of [0, 1) that a cell's tokens are summed in, to find the draw where its share is reached.
PARTS = 1_024
#: Up to so many cells are raked in memory, more as a Spark table by the same steps.
CELLS = 200_000
ROUNDS, CLOSE = 500, 1e-9


def places(ids: np.ndarray) -> np.ndarray:
    """The place of each token id: the top bits of a multiplicative hash."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)


@dataclass(frozen=True)
class Topics:
    """Weights of the places, the mean of each language and unit centres of the topics; no centres: all texts with tokens are one topic.

    Texts are compared less the mean of their language (of all where it is unknown), or topics would be languages.
    """

    weights: np.ndarray
    means: dict[str | None, np.ndarray]
    centres: np.ndarray

    def of(self, ids: np.ndarray, lang: str | None = None) -> str:
        """``empty`` without tokens, else the topic whose centre is nearest by angle, the first of equals."""
        if not len(ids):
            return EMPTY
        if not len(self.centres):
            return "topic_0"
        x = np.log1p(np.bincount(places(ids), minlength=PLACES)) * self.weights
        x /= np.sqrt(x @ x) or 1.0
        return f"topic_{int(np.argmax(self.centres @ (x - self.means.get(lang, self.means[None]))))}"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def cluster(counts: np.ndarray, langs: list[str | None], topics: int = TOPICS, rounds: int = 40) -> Topics:
    """Spherical k-means over rows of place counts, the tightest of STARTS runs. Centres start at seeded rows, likelier the farther they are from those before."""
    weights = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 0.1
    x = _unit(np.log1p(counts) * weights)
    means = {None: x.mean(0) if len(x) else np.zeros(PLACES)}
    for lang in sorted({v for v in langs if v is not None}):
        means[lang] = x[[v == lang for v in langs]].mean(0)
    if len(x) < topics:
        return Topics(weights, means, np.zeros((0, PLACES)))
    return Topics(weights, means, _started(_unit(x - np.stack([means[v] for v in langs])), topics, rounds))


def _started(x: np.ndarray, topics: int, rounds: int = 40) -> np.ndarray:
    """Centres of the tightest of STARTS seeded runs over unit rows."""
    best, tightest = None, -np.inf
    for start in range(STARTS):
        seeded = np.random.default_rng([SEED, start])
        chosen = [int(seeded.integers(len(x)))]
        near = x @ x[chosen[0]]
        while len(chosen) < topics:
            far = np.maximum(1.0 - near, 0.0)
            far = far / far.sum() if far.sum() > 0 else np.full(len(x), 1.0 / len(x))
            chosen.append(int(seeded.choice(len(x), p=far)))
            near = np.maximum(near, x @ x[chosen[-1]])
        centres = x[chosen]
        for _ in range(rounds):
            own = np.argmax(x @ centres.T, 1)
            moved = _unit(np.stack([x[own == k].sum(0) if (own == k).any() else centres[k] for k in range(topics)]))
            if np.abs(moved - centres).max() < 1e-9:
                break
            centres = moved
        tight = (x @ centres.T).max(1).sum()
        if tight > tightest:
            best, tightest = centres, tight
    return best


def packed(counts: np.ndarray) -> bytes:
    """Place counts in one byte each, or in four each if one is above 255."""
    return counts.astype("u1" if counts.max(initial=0) < 256 else "<u4").tobytes()


def unpacked(cells: pa.Array) -> np.ndarray:
    """A row of place counts for each of ``cells``."""
    rows = [np.frombuffer(x, "u1" if len(x) == PLACES else "<u4") for x in cells.to_pylist()]
    return np.stack(rows).astype(float) if rows else np.zeros((0, PLACES))


LOGS = np.log1p(np.arange(256.0))


def _logs(cells: pa.Array) -> np.ndarray:
    """The logarithms of one more than each place count, a row for each of ``cells``."""
    rows = cells.to_pylist()
    wide = np.array([len(x) != PLACES for x in rows], bool)
    out = np.empty((len(rows), PLACES))
    out[~wide] = LOGS.take(np.frombuffer(b"".join([x for x in rows if len(x) == PLACES]), "u1")).reshape(-1, PLACES)
    if wide.any():
        out[wide] = np.log1p(unpacked(cells.filter(pa.array(wide))))
    return out


def _scales(logs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What makes each weighted row a unit vector."""
    return 1.0 / np.maximum(np.sqrt((logs * logs) @ (weights * weights)), 1e-12)


def _codes(langs: list[str | None], means: Mapping[str | None, np.ndarray]) -> np.ndarray:
    """The place of each language among ``means``, that of all texts (the first) where it is unknown."""
    place = {v: k for k, v in enumerate(means)}
    return np.array([place.get(v, place[None]) for v in langs], "<i4")


def _nearest(centres: np.ndarray, weights: np.ndarray, means: np.ndarray) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Gives for logs, scales and codes the centre nearest by angle to each unit row less the mean of its language."""
    towards, offsets = np.ascontiguousarray((centres * weights).T), means @ centres.T
    return lambda logs, scales, codes: np.argmax(logs @ towards * scales[:, None] - offsets[codes], 1)


def _totals(texts: DataFrame, keyed) -> dict[str | None, tuple[int, np.ndarray]]:
    """Rows and sums by key of what ``keyed`` (logs, langs) gives for each batch: key, number of rows and their sum. Tasks add up their own; only sums reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            if batch.num_rows:
                for key, m, x in keyed(_logs(batch.column("counts")), batch.column("lang").to_pylist()):
                    n, total = sums.get(key, (0, 0.0))
                    sums[key] = (n + m, total + x)
        names = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[k][0] for k in names], pa.int64()), pa.array([sums[k][1].tobytes() for k in names], pa.binary())], names=["key", "n", "total"])

    out: dict = {}
    for r in texts.select("counts", "lang").mapInArrow(add, "key string, n long, total binary").collect():
        n, total = out.get(r["key"], (0, 0.0))
        out[r["key"]] = (n + r["n"], total + np.frombuffer(r["total"]))
    return out


def _blocks(texts: DataFrame, weights: np.ndarray, means: Mapping[str | None, np.ndarray]) -> DataFrame:
    """The texts in rows of up to BLOCK: place counts (all of one width), codes of languages, and what makes unit vectors of the weighted counts and of those less their means.

    What doesn't change from round to round is worked out once. Rows are small, for Spark reads thousands of them at a time.
    """
    table = np.stack(list(means.values()))
    names = ["counts", "codes", "scales", "leans"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("counts")
            logs, codes = _logs(cells), _codes(batch.column("lang").to_pylist(), means)
            scales = _scales(logs, weights)
            logs *= weights
            logs *= scales[:, None]
            logs -= table[codes]
            leans = 1.0 / np.maximum(np.sqrt(np.einsum("ij,ij->i", logs, logs)), 1e-12)
            rows, found = cells.to_pylist(), []
            for width, most in ((PLACES, BLOCK), (4 * PLACES, BLOCK // 4)):
                own = [k for k, x in enumerate(rows) if len(x) == width]
                for at in range(0, len(own), most):
                    some = own[at : at + most]
                    found.append((b"".join([rows[k] for k in some]), *[x[some].tobytes() for x in (codes, scales, leans)]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in range(len(names))], names=names)

    return cut(texts.select("counts", "lang").mapInArrow(gather, ", ".join(f"{c} binary" for c in names)))


def _moved(blocks: DataFrame, centres: np.ndarray, weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The centres of the texts nearest to each of ``centres``: unit sums of unit vectors. Tasks add up their own; a centre without texts stays."""
    shape, held = centres.shape, (len(centres), len(means))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, less, nearest = np.zeros(shape), np.zeros(held), _nearest(centres, weights, means)
        for batch in batches:
            for counts, *facts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                codes, scales, leans = (np.frombuffer(x, kind) for x, kind in zip(facts, ("<i4", "f8", "f8"), strict=True))
                narrow = len(counts) == len(codes) * PLACES
                logs = (LOGS.take(np.frombuffer(counts, "u1")) if narrow else np.log1p(np.frombuffer(counts, "<u4").astype(float))).reshape(-1, PLACES)
                own = nearest(logs, scales, codes)
                part = np.zeros((len(centres), len(codes)))
                part[own, np.arange(len(codes))] = scales * leans
                sums += part @ logs
                np.add.at(less, (own, codes), leans)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (sums, less)], names=["sums", "less"])

    rows = blocks.mapInArrow(add, "sums binary, less binary").collect()
    sums = sum((np.frombuffer(r["sums"]) for r in rows), np.zeros(centres.size)).reshape(shape)
    less = sum((np.frombuffer(r["less"]) for r in rows), np.zeros(held[0] * held[1])).reshape(held)
    return np.where((less > 0).any(1)[:, None], _unit(sums * weights - less @ means), centres)


def _fit(counted: DataFrame, limit: int = SAMPLE, topics: int = TOPICS, sweeps: int = SWEEPS) -> Topics:
    """Topics from all different texts of ``counted`` (tag, lang, counts, tokens): weights, means and centres are sums over all of them.

    The ``limit`` texts with the smallest digests only give the centres' starting points.
    """
    texts = cut(counted.where("tokens > 0").groupBy("tag").agg(F.first("counts").alias("counts"), F.min("lang").alias("lang")))
    seen = _totals(texts, lambda logs, langs: [(None, len(logs), (logs > 0).sum(0))])
    n, places_in = seen.get(None, (0, np.zeros(PLACES)))
    weights = np.log((1 + n) / (1 + places_in)) + 0.1

    def by_lang(logs: np.ndarray, langs: list[str | None]) -> list[tuple]:
        scales, parts = _scales(logs, weights), {}
        for k, v in enumerate(langs):
            parts.setdefault(v, []).append(k)
        return [(v, len(own), scales[own] @ logs[own] * weights) for v, own in parts.items()]

    found = _totals(texts, by_lang)
    whole = sum((total for _, total in found.values()), np.zeros(PLACES)) / max(n, 1)
    means = {None: whole} | {v: total / m for v, (m, total) in sorted((k, x) for k, x in found.items() if k is not None)}
    if n < topics:
        return Topics(weights, means, np.zeros((0, PLACES)))
    table = np.stack(list(means.values()))
    rows = texts.orderBy("tag").limit(max(limit, topics)).select("counts", "lang").toArrow()
    first = _logs(rows.column("counts").combine_chunks())
    centres = _started(_unit(first * weights * _scales(first, weights)[:, None] - table[_codes(rows.column("lang").to_pylist(), means)]), topics)
    blocks = _blocks(texts, weights, means)
    drop(texts)
    for _ in range(sweeps):
        before, centres = centres, _moved(blocks, centres, weights, table)
        if np.abs(centres - before).max() < 1e-9:
            break
    drop(blocks)
    return Topics(weights, means, centres)


def read_counts(text: Column, tokenizer: str | None = None) -> Column:
    """Struct of ``tokens`` and packed place ``counts``. Null texts are empty."""

    @F.arrow_udf("struct<tokens: long, counts: binary>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids_of = worker_encoder(tokenizer).ids
        for texts in batches:
            rows = []
            for x in texts:
                ids = ids_of(x.as_py() or "")
                rows.append({"tokens": len(ids), "counts": packed(np.bincount(places(ids), minlength=PLACES))})
            yield pa.array(rows, pa.struct([("tokens", pa.int64()), ("counts", pa.binary())]))

    return read(text.cast("string"))


def fit_topics(df: DataFrame, text: str = "text", limit: int = SAMPLE, topics: int = TOPICS, tokenizer: str | None = None) -> Topics:
    """Topics from all different texts of ``df`` with tokens, started from at most ``limit``; only sums and the starting texts' counts reach the driver."""
    small_batches(df.sparkSession)
    own = F.col(f"`{text}`")
    return _fit(cut(df.select(text_tag(own).alias("tag"), F.col("lang").cast("string").alias("lang"), read_counts(own, tokenizer).alias("r")).select("tag", "lang", "r.*")), limit, topics)


def topic_of(counts: Column, tokens: Column, lang: Column, topics: Topics) -> Column:
    """The topic of packed counts, as :meth:`Topics.of` gives it."""

    @F.arrow_udf("string")
    def near(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        nearest = _nearest(topics.centres, topics.weights, np.stack(list(topics.means.values())))
        for held, sizes, langs in batches:
            own = np.zeros(len(held), int)
            if len(topics.centres) and len(held):
                logs = _logs(held)
                own = nearest(logs, _scales(logs, topics.weights), _codes(langs.to_pylist(), topics.means))
            yield pa.array([f"topic_{k}" if n else EMPTY for k, n in zip(own, sizes.to_pylist(), strict=True)], pa.string())

    return near(counts, tokens, lang)


def tempered(shares: Mapping[str, float], exponent: float) -> dict[str, float]:
    """Shares to the power of ``exponent``, scaled to sum 1: below 1 small groups gain."""
    raised = {k: v**exponent for k, v in shares.items()}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(held: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray], total: float, rounds: int = ROUNDS, close: float = CLOSE) -> np.ndarray:
    """Cell totals near ``held`` in proportion whose marginals meet ``targets`` times ``total``, no cell above ``held``.

    ``axes[d]`` is each cell's index into ``targets[d]``. Each sweep scales every
    marginal in turn and cuts cells at what they hold; where the targets ask
    for more than there is, the nearest feasible totals result.
    """
    fitted = held * (total / held.sum())
    for _ in range(rounds):
        before = fitted
        for index, target in zip(axes, targets, strict=True):
            now = np.bincount(index, fitted, len(target))
            factor = np.divide(target * total, now, out=np.zeros_like(now), where=now > 0)
            fitted = np.minimum(fitted * factor[index], held)
        if np.abs(fitted - before).max() <= close * total:
            break
    return fitted


def _aims(marginal: Mapping[str | None, float], target: Mapping[str, float] | None, exponent: float) -> dict[str | None, float]:
    """Wanted shares of a dimension's values."""
    whole = sum(marginal.values())
    wanted = tempered({k: v / whole for k, v in marginal.items()}, exponent) if target is None else {v: target.get(v, 0.0) for v in marginal}
    total = sum(wanted.values()) or 1.0
    return {k: v / total for k, v in wanted.items()}


def _rake_here(cells: DataFrame, targets, rate: float, temper: Mapping[str, float], rounds: int = ROUNDS) -> DataFrame:
    rows = sorted(cells.collect(), key=lambda r: tuple((r[d] is None, r[d] or "") for d in DIMENSIONS))
    schema = "source string, lang string, topic string, probability double"
    if not rows:
        return cells.sparkSession.createDataFrame([], schema)
    held = np.array([r["held"] for r in rows], float)
    axes, aims = [], []
    for d in DIMENSIONS:
        place: dict = {}
        index = np.array([place.setdefault(r[d], len(place)) for r in rows])
        wanted = _aims(dict(zip(place, np.bincount(index, held, len(place)), strict=True)), (targets or {}).get(d), temper.get(d, 1.0))
        axes.append(index)
        aims.append(np.array([wanted[v] for v in place]))
    fitted = rake(held, axes, aims, rate * held.sum(), rounds)
    solved = [(*(r[d] for d in DIMENSIONS), float(p)) for r, p in zip(rows, np.minimum(fitted / held, 1.0), strict=True)]
    return cells.sparkSession.createDataFrame(solved, schema)


def _rake_tables(cells: DataFrame, targets, rate: float, temper: Mapping[str, float], rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """The same sweeps where the cells are too many for one machine: each scaling is a join of the cells with a marginal."""
    whole = cells.agg(F.sum("held").cast("double")).first()[0]
    total, aims = rate * whole, {}
    for d in DIMENSIONS:
        given = (targets or {}).get(d)
        marginal = cells.groupBy(d).agg(F.sum("held").cast("double").alias("held"))
        if given is None:
            wanted = marginal.withColumn("want", F.pow(F.col("held") / whole, F.lit(temper.get(d, 1.0))))
        else:
            listed = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], "value string, want double")
            wanted = marginal.join(listed, F.col(d).eqNullSafe(F.col("value")), "left").select(d, F.coalesce("want", F.lit(0.0)).alias("want"))
        share = F.col("want") / F.lit(wanted.agg(F.sum("want")).first()[0] or 1.0)
        aims[d] = cut(wanted.select(F.col(d).alias("value"), share.alias("want")))
    state = cut(cells.withColumn("fitted", F.col("held") * (total / whole)))
    for _ in range(rounds):
        now = state.withColumn("before", F.col("fitted"))
        for d in DIMENSIONS:
            sums = now.groupBy(F.col(d).alias("key")).agg(F.sum("fitted").alias("sum"))
            factors = sums.join(aims[d], F.col("key").eqNullSafe(F.col("value"))).select("key", F.when(F.col("sum") > 0, F.col("want") * total / F.col("sum")).otherwise(0.0).alias("factor"))
            now = cut(now.join(factors, F.col(d).eqNullSafe(F.col("key"))).select(*DIMENSIONS, "held", "before", F.least(F.col("fitted") * F.col("factor"), F.col("held").cast("double")).alias("fitted")))
        drop(state)
        state = now
        if now.agg(F.max(F.abs(F.col("fitted") - F.col("before")))).first()[0] <= close * total:
            break
    return state.select(*DIMENSIONS, F.least(F.col("fitted") / F.col("held"), F.lit(1.0)).alias("probability"))


def probabilities(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, rate: float = RATE, temper: Mapping[str, float] = TEMPER, in_memory: int = CELLS, rounds: int = ROUNDS) -> DataFrame:
    """``(source, lang, topic, probability)`` of cells that have source, lang, topic and ``held`` tokens.

    ``targets`` gives weights by dimension and value (values not named get none); dimensions
    without them aim at their tempered observed shares. More cells than ``in_memory`` stay on Spark.
    """
    few = cells.limit(in_memory + 1).count() <= in_memory
    return (_rake_here if few else _rake_tables)(cells, targets, rate, temper, rounds)


def draw(doc_id: Column, tag: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that the seed and the id decide, and the text's digest where the id is null: the first 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), tag.cast("string")))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def cutoffs(marked: DataFrame, solved: DataFrame, parts: int = PARTS) -> DataFrame:
    """``solved`` (cells, ``__probability``) with ``__part`` and ``__last``: documents are taken whose draw lies in a part before that, or in it and isn't above ``__last``.

    ``marked`` has the cells' documents with ``__draw`` and ``__n_tokens``. In the order of their draws, equal ones together, those are taken whose middle
    lies within the cell's share of its tokens. Parts are summed first; only the one part of a cell where its share ends is looked into.
    """
    cell = [f"__{d}" for d in DIMENSIONS]
    part = F.least(F.floor(F.col("__draw") * parts), F.lit(parts - 1)).cast("int")
    sums = marked.groupBy(*cell, part.alias("__p")).agg(F.sum("__n_tokens").alias("__sum"))
    by = Window.partitionBy(*cell)
    placed = sums.withColumns({"__before": F.sum("__sum").over(by.orderBy("__p")) - F.col("__sum"), "__held": F.sum("__sum").over(by)})
    on = F.lit(True)
    for d in DIMENSIONS:
        on = on & F.col(f"__{d}").eqNullSafe(F.col(f"__c_{d}"))
    share = F.col("__probability") * F.col("__held")
    inside = placed.join(sized(solved), on).where(F.col("__before") <= share)
    edges = cut(inside.groupBy(*[f"__c_{d}" for d in DIMENSIONS], "__probability").agg(F.max("__p").alias("__part"), F.max_by("__before", "__p").alias("__begin"), F.max(share).alias("__share")))
    there = marked.select(*cell, "__draw", "__n_tokens", part.alias("__p")).join(sized(edges), on & (F.col("__p") == F.col("__part")))
    draws = there.groupBy(*[f"__c_{d}" for d in DIMENSIONS], "__draw", "__begin", "__share").agg(F.sum("__n_tokens").alias("__n"))
    up_to = Window.partitionBy(*[f"__c_{d}" for d in DIMENSIONS]).orderBy("__draw")
    taken = draws.withColumn("__mid", F.col("__begin") + F.sum("__n").over(up_to) - F.col("__n") / 2).where(F.col("__mid") <= F.col("__share"))
    last = taken.groupBy(*[F.col(f"__c_{d}").alias(f"__l_{d}") for d in DIMENSIONS]).agg(F.max("__draw").alias("__last"))
    same = F.lit(True)
    for d in DIMENSIONS:
        same = same & F.col(f"__c_{d}").eqNullSafe(F.col(f"__l_{d}"))
    return edges.join(last, same, "left").select(*[f"__c_{d}" for d in DIMENSIONS], "__probability", "__part", "__last")


def _with_cells(df: DataFrame, targets, rate: float, temper: Mapping[str, float], seed: int, text: str, doc_id: str, columns: list[str], in_memory: int) -> DataFrame:
    # the texts are tokenized once; the fit, raking and sampling read what is kept
    small_batches(df.sparkSession)
    held = [F.col(f"`{c}`") for c in columns]
    keys = [F.col(c).cast("string").alias(f"__{c}") for c in ("source", "lang")]
    tag = text_tag(F.col(f"`{text}`"))
    number = draw(F.col(f"`{doc_id}`"), tag, seed)
    counted = cut(df.select(*held, *keys, tag.alias("__tag"), number.alias("__draw"), read_counts(F.col(f"`{text}`")).alias("__read")).select("*", F.col("__read.tokens").alias("__tokens"), F.col("__read.counts").alias("__counts")).drop("__read"))
    topics = _fit(counted.select(F.col("__tag").alias("tag"), F.col("__lang").alias("lang"), F.col("__tokens").alias("tokens"), F.col("__counts").alias("counts")))
    named = topic_of(F.col("__counts"), F.col("__tokens"), F.col("__lang"), topics).alias("__topic")
    # a row weighs something however short it is
    marked = cut(counted.select(*held, *[f"__{c}" for c in ("source", "lang", "draw")], named, F.greatest(F.col("__tokens"), F.lit(1)).alias("__n_tokens")))
    drop(counted)
    cells = cut(marked.groupBy(*[F.col(f"__{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("__n_tokens").alias("held")))
    solved = cut(probabilities(cells, targets, rate, temper, in_memory).select(*[F.col(d).alias(f"__c_{d}") for d in DIMENSIONS], F.col("probability").alias("__probability")))
    on = F.lit(True)
    for d in DIMENSIONS:
        on = on & F.col(f"__{d}").eqNullSafe(F.col(f"__c_{d}"))
    joined = marked.join(sized(cut(cutoffs(marked, solved))), on)
    part = F.least(F.floor(F.col("__draw") * PARTS), F.lit(PARTS - 1))
    return joined.withColumn("__sampled", (part < F.col("__part")) | ((part == F.col("__part")) & F.coalesce(F.col("__draw") <= F.col("__last"), F.lit(False))))


def mix(df: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, rate: float = RATE, temper: Mapping[str, float] = TEMPER, seed: int = SEED, text: str = "text", doc_id: str = "doc_id", columns: list[str] | None = None, in_memory: int = CELLS) -> DataFrame:
    """Add ``topic``, ``n_tokens``, ``probability`` and ``sampled`` to every row of ``df``.

    A cell's documents are sampled in the order of their draws, up to its probability's share of its tokens; the
    same seed and id always draw the same, so repeated rows share their fate. Rows without an id draw by their text.
    Null sources and languages are values of their own. Columns that clash with
    the added ones are replaced; an empty table gives no rows. ``columns``
    are those of ``df`` to return, all if not given.
    """
    added = ("topic", "n_tokens", "probability", "sampled")
    kept = [c for c in without(df, added).columns if columns is None or c in columns]
    return _with_cells(df, targets, rate, temper, seed, text, doc_id, kept, in_memory).select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"__{c}").alias(c) for c in added])


def sample(df: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, rate: float = RATE, temper: Mapping[str, float] = TEMPER, seed: int = SEED, text: str = "text", doc_id: str = "doc_id", in_memory: int = CELLS) -> DataFrame:
    """The sampled rows of :func:`mix`, with the columns of ``df``."""
    return _with_cells(df, targets, rate, temper, seed, text, doc_id, df.columns, in_memory).where("__sampled").select(*[F.col(f"`{c}`") for c in df.columns])
