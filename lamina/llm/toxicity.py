"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols by a lexicon, which gives insults their weight. Five
weighted transducers mark insults, threats, negation, reported speech and
targets; they are composed into one machine, whose arcs carry the sums of
theirs, and which reads each clause that holds an insult or a verb of harm. A
verb of harm alone is no threat: it takes a target. A document's score is a curve over the weight of
its clauses' paths, nothing else: an insult weighs what the lexicon says, more if it is aimed, a part of it if negated
or reported, and a threat weighs more than an aimed insult. Insult words and stems, these weights
and the curve are learned from labelled documents, the weights within bounds that keep their order and near the
grammar's own where the documents say nothing; the other word lists are fixed.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, small_batches
from .frames import without
from .text_stats import labelled

#: Labelled rows used, at most.
LABELLED = 12_000
STEMS = (4, 5, 6, 7, 8)
#: Seed words by symbol: insult, harm, target, first person, intention, negation, reported speech.
SEEDS = {
    "I": "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting imbecile cretin bastard dumb dummkopf arschloch trottel connard imbécile pendejo estúpido",
    "H": "kill murder strangle shoot stab lynch umbringen erschießen tuer égorger matar matarte",
    "T": "you your yours yourself u he she they them him her du dich dir dein ihr euch tu toi vous ton ta usted tú ti ustedes vosotros",
    "F": "i we ich wir je nous yo nosotros",
    "W": "will gonna going shall i'll we'll werde werden vais allons voy vamos",
    "N": "not no never nor isn't aren't don't wasn't nicht kein keine nie pas jamais aucun nunca jamás tampoco",
    "R": "said says called calls quoted quotes wrote claimed reported alleged sagte sagt nannte schrieb behauptete dit disait écrit appelé dijo dice llamó escribió",
}
#: ``S`` is a word with a learned stem: suspicious, but not a word that is aimed at anyone.
SYMBOLS = (*SEEDS, "S", "O")
CLAUSE = re.compile(r"[^.!?;:\n\r,()\[\]\"“”«»]+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Words over which a negation, a verb of harm or an insult waits for what it belongs to.
REACH = 3
FEATURES = ("insult", "aimed", "negated", "reported", "threat")
#: The most that one word weighs, and what a seed weighs: alone it stays below the least LEVEL.
HEAVIEST = 3.0
#: What a stem weighs at most, as a share of that: it stands for words that no one has seen.
STEM = 2 / 3
#: For each feature but insults, whose factor is 1, and for level and slope of the curve: least, own and greatest value. The weight of
#: one aimed seed, and of a threat with intention and target, passes the greatest level; that of one plain or reported seed doesn't pass the least.
BOUNDS = {"aimed": (3.0, 3.5, 6.0), "negated": (0.0, 0.2, 0.3), "reported": (0.1, 0.35, 0.4), "threat": (2.0, 2.5, 4.0), "level": (3.05, 5.0, 5.95), "slope": (1.0, 4.0, 12.0)}


@dataclass(frozen=True)
class Transducer:
    """Deterministic weighted transducer: a move gives the next state, an output and a weight.

    A symbol without a move goes to ``idle`` of the state and passes through at weight 0.
    """

    moves: dict
    idle: dict
    start: object = 0

    def step(self, state, symbol: str):
        return self.moves.get((state, symbol)) or (self.idle.get(state, state), symbol, 0.0)


def compose(first: Transducer, second: Transducer, alphabet: Iterable[str]) -> Transducer:
    """The transducer that feeds ``first``'s output to ``second`` and adds their weights, over what is reachable from the starts."""
    start = (first.start, second.start)
    moves, todo, seen = {}, [start], {start}
    alphabet = tuple(alphabet)
    while todo:
        a, b = state = todo.pop()
        for symbol in alphabet:
            a2, middle, w1 = first.step(a, symbol)
            b2, out, w2 = second.step(b, middle)
            moves[state, symbol] = ((a2, b2), out, w1 + w2)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return Transducer(moves, {}, start)


def insults() -> Transducer:
    """Insults pass; one right after another weighs more."""
    return Transducer({(0, "I"): (1, "I", 0.0), (1, "I"): (1, "I", 0.5)}, {1: 0})


def threats() -> Transducer:
    """``H!`` is a verb of harm with an intention before it; ``T!`` is a target that one with or without intention meets soon.

    States: none, (intention, word by word), (harm with intention, words left) and (harm without, words left).
    """
    moves: dict = {}
    idle: dict = {}
    meant = [("meant", k) for k in range(REACH + 1)]
    for state in (0, *meant):
        moves[state, "F"], moves[state, "W"] = (meant[REACH], "F", 0.0), (meant[REACH], "W", 0.0)
    for state in meant:
        idle[state] = meant[state[1] - 1] if state[1] else 0
        moves[state, "H"] = (("sure", REACH), "H!", 0.0)
    moves[0, "H"] = (("bare", REACH), "H", 0.0)
    for kind, weight in (("sure", 3.0), ("bare", 1.0)):
        for k in range(1, REACH + 1):
            state = (kind, k)
            idle[state] = (kind, k - 1) if k > 1 else 0
            moves[state, "T"] = (0, "T!", weight)
            moves[state, "H"] = ((kind, REACH), "H!", 0.0) if kind == "sure" else ((kind, REACH), "H", 0.0)
    return Transducer(moves, idle)


#: Outputs of the first two machines that say something toxic.
MARKS = ("I", "S", "H!", "T!")


def negations() -> Transducer:
    """Marks within reach of a negation get ``-`` and weigh less."""
    moves = {(k, x): (k - 1, f"{x}-", -0.5) for k in range(1, REACH + 1) for x in MARKS}
    moves |= {(k, "N"): (REACH, "N", 0.0) for k in range(REACH + 1)}
    return Transducer(moves, {k: k - 1 for k in range(1, REACH + 1)})


def reports() -> Transducer:
    """Marks after a verb of speech get ``r`` and weigh less."""
    marks = [f"{x}{n}" for x in MARKS for n in ("", "-")]
    return Transducer({(1, m): (1, f"{m}r", -0.5) for m in marks} | {(0, "R"): (1, "R", 0.0)}, {})


def targets() -> Transducer:
    """Insults after a target get ``+``; a target soon after an insult without one becomes ``T+``."""
    said = [f"I{n}{r}" for n in ("", "-") for r in ("", "r")]
    moves: dict = {("aimed", m): ("aimed", f"{m}+", 1.0) for m in said}
    for x in ("T", "T!", "T!-", "T!r", "T!-r"):
        moves[0, x] = ("aimed", x, 0.0)
    for m in said:
        moves[0, m] = ((m, REACH), m, 0.0)
        for other in said:
            for k in range(1, REACH + 1):
                moves[(other, k), m] = ((m, REACH), m, 0.0)
    idle: dict = {}
    for m in said:
        for k in range(1, REACH + 1):
            idle[m, k] = (m, k - 1) if k > 1 else 0
            moves[(m, k), "T"] = ("aimed", f"T{m[1:]}+", 1.0)
    return Transducer(moves, idle)


MACHINES = (insults, threats, negations, reports, targets)


def grammar() -> Transducer:
    """The five machines, composed in order."""
    whole = MACHINES[0]()
    for make in MACHINES[1:]:
        whole = compose(whole, make(), SYMBOLS)
    return whole


def kind_of(out: str) -> str | None:
    """The feature that an output of the grammar counts for; of an aimed insult, its arc does, and the word as an insult."""
    if out[0] not in "IS" and not out.endswith("+") and "!" not in out:
        return None
    return "negated" if "-" in out else "reported" if "r" in out else "threat" if "!" in out else "aimed" if "+" in out else "insult"


@dataclass
class Lexicon:
    """Symbol and weight of words and of word stems."""

    words: dict[str, tuple[str, float]] = field(default_factory=dict)
    stems: dict[str, tuple[str, float]] = field(default_factory=dict)

    def look(self, word: str) -> tuple[str, float]:
        found = self.words.get(word)
        if found is None and self.stems:
            for k in range(min(STEMS), min(max(STEMS), len(word)) + 1):
                if found := self.stems.get(word[:k]):
                    break
        return found or ("O", 0.0)

    def charged(self) -> list[str]:
        """Terms that make a clause worth reading."""
        return [t for part in (self.words, self.stems) for t, (s, _) in part.items() if s in "IHS"]


class Reader:
    """Reads texts with one lexicon: a string automaton finds clauses with insults or threats, the grammar scores them."""

    def __init__(self, lexicon: Lexicon) -> None:
        import ahocorasick

        self.lexicon, self.machine = lexicon, grammar()
        self.finder = ahocorasick.Automaton()
        for term in lexicon.charged():
            self.finder.add_word(term, (len(term), term in lexicon.stems))
        if len(self.finder):
            self.finder.make_automaton()

    def hits(self, low: str) -> list[int]:
        if not len(self.finder):
            return []
        out, n = [], len(low)
        for end, (size, stem) in self.finder.iter(low):
            at = end - size + 1
            if (at == 0 or not low[at - 1].isalpha()) and (stem or end + 1 == n or not low[end + 1].isalpha()):
                out.append(at)
        return sorted(set(out))

    def features(self, text: str) -> list[float]:
        low = text.lower()
        sums = dict.fromkeys(FEATURES, 0.0)
        hits = self.hits(low)
        if hits:
            for m in CLAUSE.finditer(low):
                k = bisect_left(hits, m.start())
                if k < len(hits) and hits[k] < m.end():
                    self._clause(m[0], sums)
        return [max(sums[k], 0.0) for k in FEATURES]

    def _clause(self, clause: str, sums: dict[str, float]) -> None:
        state = self.machine.start
        for word in WORD.findall(clause):
            symbol, own = self.lexicon.look(word)
            state, out, weight = self.machine.step(state, symbol)
            if kind := kind_of(out):
                # an insult weighs what the lexicon says, the rest what the arcs say
                own = own if symbol in "IS" else 0.0
                if kind == "aimed":
                    sums["insult"] += own
                    sums["aimed"] += 1.0
                else:
                    sums[kind] += weight + own


@dataclass
class Model:
    """Lexicon, and the values of BOUNDS by name."""

    lexicon: Lexicon
    weights: dict[str, float]

    def factors(self) -> list[float]:
        """The factor of each of FEATURES in a path's weight."""
        return [1.0, *(self.weights[f] for f in FEATURES[1:])]


def clause_features(text: Column, lexicon: Lexicon) -> Column:
    """Array of the sums in ``FEATURES``; a null text counts as empty."""

    @F.arrow_udf("array<double>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(lexicon)
        for texts in batches:
            yield pa.array([reader.features(x.as_py() or "") for x in texts], pa.list_(pa.float64()))

    return read(text.cast("string"))


def _apart(sample: DataFrame) -> DataFrame:
    """One document of near copies: those that share the least hash of their word triples, thrice over."""
    words = sample.withColumn("words", F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^\\p{L}]+"), ""))
    count = F.greatest(F.size("words") - 2, F.lit(1))

    def least(salt: int) -> Column:
        return F.array_min(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(F.lit(salt), F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))))

    drawn = cut(words.select("doc_id", "label", F.array_distinct("words").alias("words"), *[least(k).alias(f"m{k}") for k in range(3)]))
    for k in range(3):
        first = drawn.groupBy(f"m{k}").agg(F.min("doc_id").alias("doc_id"))
        drawn = drawn.join(first, [f"m{k}", "doc_id"], "left_semi")
    return drawn.select("label", "words")


def _prefixes(words: Column, size: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.char_length(w) > size), lambda w: F.substring(w, 1, size))


def seed_lexicon() -> Lexicon:
    """The seed words alone; insults among them weigh HEAVIEST."""
    return Lexicon({w: (s, HEAVIEST if s == "I" else 0.0) for s, words in SEEDS.items() for w in words.split()})


def _bound(histogram: dict[int, int], base: float) -> float:
    """The log-likelihood ratio a term must pass, given how many terms are in how many documents.

    It grows with the log of the number of terms tried. Terms so rare that they couldn't
    pass it if all their documents were toxic aren't tries.
    """
    tried, best = sum(histogram.values()), math.inf
    for n in sorted(histogram):
        bound = math.log(max(tried, 2)) + 2.0
        best = min(best, bound)
        if n * math.log(1 / base) >= bound:
            break
        tried -= histogram[n]
    return best


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Seeds, and words and stems that appear in toxic documents far beyond chance.

    Terms are judged by a log-likelihood ratio against a bound that allows for
    the number of terms tried, over documents that aren't near copies of each
    other. A seed that clean documents use as much loses its place. What is
    learned is bounded by the words of the sample, and weighs its log odds, between 0.5 and HEAVIEST, for stems STEM of that.
    """
    documents = cut(_apart(sample))
    totals = documents.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    n, toxic = totals["n"], totals["toxic"] or 0
    lexicon = seed_lexicon()
    if not 0 < toxic < n:
        return lexicon
    word = F.transform(F.filter("words", lambda w: F.char_length(w) >= 3), lambda w: F.concat(w, F.lit("$")))
    stems = [_prefixes(F.col("words"), k) for k in STEMS]
    seen = documents.select("label", F.explode(F.array_distinct(F.concat(word, *stems))).alias("term"))
    counts = cut(seen.groupBy("term").agg(F.sum("label").alias("pos"), F.count("*").alias("n")))
    base = toxic / n
    bound = _bound({r["n"]: r["count"] for r in counts.groupBy("n").count().collect()}, base)
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    part = lambda x, share: F.when(x > 0, x * F.log(x / (F.col("n") * share))).otherwise(0.0)
    evidence = part(pos, base) + part(neg, 1 - base)
    odds = F.log((pos + 0.5) / (toxic - pos + 0.5)) - F.log((neg + 0.5) / (n - toxic - neg + 0.5))
    seeds = [f"{w}$" for w in SEEDS["I"].split() + SEEDS["H"].split()]
    strong = (evidence > bound) & (odds > F.when(F.col("term").endswith("$"), 2.0).otherwise(1.2))
    found = counts.select("term", "pos", "n", evidence.alias("evidence"), odds.alias("odds"))
    rows = found.where(strong).orderBy(F.desc("evidence"), "term").collect()
    for r in found.where(F.col("term").isin(seeds) & (F.col("n") >= 20) & (F.col("odds") < 1.0)).collect():
        lexicon.words.pop(r["term"][:-1], None)
    words = {r["term"][:-1]: r for r in rows if r["term"].endswith("$")}
    for word, r in words.items():
        if lexicon.words.get(word, ("I",))[0] == "I":
            lexicon.words[word] = ("I", float(min(max(r["odds"], 0.5), HEAVIEST)))
    # a stem stands for many words: one word must not make most of it; of nested stems the most telling is taken, the longest of equals
    for r in sorted((r for r in rows if not r["term"].endswith("$")), key=lambda r: (-r["evidence"], -len(r["term"]))):
        stem = r["term"]
        top = max((w["pos"] for t, w in words.items() if t.startswith(stem)), default=0)
        if top < 0.6 * r["pos"] and not any(stem.startswith(s) or s.startswith(stem) for s in lexicon.stems):
            lexicon.stems[stem] = ("S", float(min(max(r["odds"], 0.5), HEAVIEST * STEM)))
    return lexicon


def weight_of(x: np.ndarray, weights: dict[str, float]) -> np.ndarray:
    """Path weights of documents from their FEATURES."""
    return x[:, 0] + sum(weights[f] * x[:, k] for k, f in enumerate(FEATURES) if k)


def learn_weights(x: np.ndarray, y: np.ndarray, pull: float = 0.5, rounds: int = 40) -> dict[str, float]:
    """The values within BOUNDS that make the labels likeliest, less ``pull`` times the squared distance from the grammar's own, in shares of the bounds.

    One value after the other moves by steps that shrink, so documents without, say, a threat leave its weight where it was.
    """
    best = {name: own for name, (_, own, _) in BOUNDS.items()}

    def loss(w: dict[str, float]) -> float:
        z = w["slope"] * (np.log1p(weight_of(x, w)) - math.log1p(w["level"]))
        return float(np.logaddexp(0.0, np.where(y > 0, -z, z)).sum()) + pull * sum(((w[n] - own) / (high - low)) ** 2 for n, (low, own, high) in BOUNDS.items())

    now, step = loss(best), 0.25
    for _ in range(rounds):
        moved = False
        for name, (low, _, high) in BOUNDS.items():
            for sign in (1, -1):
                tried = best | {name: min(max(best[name] + sign * step * (high - low), low), high)}
                if (then := loss(tried)) < now - 1e-9:
                    best, now, moved = tried, then, True
                    break
        step = step if moved else step / 2
    return best


def fit(df: DataFrame, labels: DataFrame, label: str = "toxic", where: Column | None = None, limit: int = LABELLED, text: str = "text", doc_id: str = "doc_id") -> Model:
    """Learn lexicon, weights and curve from at most ``limit`` labelled documents, of which only the few sums of each reach the driver.

    Without toxic or without clean labels the seeds and the grammar's own weights score.
    """
    small_batches(df.sparkSession)
    sample = cut(labelled(df, labels, label, where, limit, text, doc_id))
    lexicon = learn_lexicon(sample)
    rows = sample.select("label", clause_features(F.col("text"), lexicon).alias("x")).collect()
    x, y = np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r["label"] for r in rows], float)
    return Model(lexicon, learn_weights(x, y) if len(y) and y.min() < y.max() else {name: own for name, (_, own, _) in BOUNDS.items()})


def _with_score(df: DataFrame, model: Model, text: str) -> DataFrame:
    small_batches(df.sparkSession)
    read = df.withColumn("__features", clause_features(F.col(text), model.lexicon))
    total = F.lit(0.0)
    for k, w in enumerate(model.factors()):
        total = total + F.col("__features")[k] * w
    total = model.weights["slope"] * (F.log1p(total) - math.log1p(model.weights["level"]))
    return read.withColumn("__score", 1.0 / (1.0 + F.exp(-total)))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1, higher: likelier toxic) and ``predicted`` to every row of ``df``.

    Whole texts are read; null and empty ones score as texts without matches.
    Columns named score or predicted are replaced, others kept; rows are
    independent, so copies score alike and an empty table gives no rows.
    """
    kept = without(df, ["score", "predicted"]).columns
    return _with_score(df, model, text).select(*kept, F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def reject(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``df`` that aren't predicted toxic, with its columns."""
    return _with_score(df, model, text).where("__score < 0.5").select(*df.columns)
