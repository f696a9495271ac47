"""Quality rules as a learned decision list.

Sequential covering on a bounded labelled sample: each rule grows as a
conjunction of thresholds by information gain on one part of the sample, is
pruned on the other, and takes what it covers out. The list becomes one ordered
Spark conditional; no Python runs on the documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .frames import without
from .text_stats import LABELLED, RATES, STATS, labelled, with_rates

MAX_RULES, MAX_TERMS, THRESHOLDS = 12, 3, 64
#: A rule must be right on so many of the pruning rows that it covers, and cover so many.
PRECISION, SUPPORT = 0.9, 3


@dataclass(frozen=True)
class Term:
    stat: str
    above: bool
    limit: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values > self.limit if self.above else values <= self.limit

    def column(self) -> Column:
        return F.col(self.stat) > self.limit if self.above else F.col(self.stat) <= self.limit

    def __str__(self) -> str:
        return f"{self.stat} {'>' if self.above else '<='} {self.limit:.6g}"


@dataclass
class DecisionList:
    """Rules that reject, in order; what none of them covers is kept."""

    rules: list[tuple[Term, ...]] = field(default_factory=list)

    def verdict(self) -> Column:
        """True where no rule rejects, as one chain of WHEN branches."""
        out = None
        for rule in self.rules:
            both = F.lit(True)
            for term in rule:
                both = both & term.column()
            out = F.when(both, F.lit(False)) if out is None else out.when(both, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) + "\nelse keep"


def _covered(rule: list[Term], data: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for term in rule:
        out &= term.holds(data[term.stat])
    return out


def _grow(data: dict[str, np.ndarray], bad: np.ndarray) -> list[Term]:
    rule: list[Term] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_TERMS:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p or not n:
            break
        base, best, chosen = np.log2(p / (p + n)), 0.0, None
        for stat, values in data.items():
            cuts = np.unique(np.quantile(values[inside & bad], np.linspace(0, 1, THRESHOLDS)))
            cuts = np.unique(np.concatenate([cuts, np.quantile(values[inside & ~bad], np.linspace(0, 1, THRESHOLDS))]))
            cuts = (cuts[1:] + cuts[:-1]) / 2
            good_in, bad_in = np.sort(values[inside & ~bad]), np.sort(values[inside & bad])
            p_low, n_low = np.searchsorted(bad_in, cuts, "right"), np.searchsorted(good_in, cuts, "right")
            for above, pp, nn in ((False, p_low, n_low), (True, p - p_low, n - n_low)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), 0.0)
                if len(gain) and gain.max() > best + 1e-9:
                    best, k = float(gain.max()), int(gain.argmax())
                    chosen = Term(stat, above, float(cuts[k]))
        if chosen is None:
            break
        rule.append(chosen)
        inside &= chosen.holds(data[chosen.stat])
    return rule


def learn(data: dict[str, np.ndarray], bad: np.ndarray) -> DecisionList:
    """A list that rejects ``bad`` rows; every third row prunes. Too few or one-sided rows give the empty list."""
    n = len(bad)
    prune = np.arange(n) % 3 == 2
    left, out = np.ones(n, bool), DecisionList()
    while len(out.rules) < MAX_RULES:
        grow = left & ~prune
        if (grow & bad).sum() < SUPPORT or not (grow & ~bad).any():
            break
        rule = _grow({k: v[grow] for k, v in data.items()}, bad[grow])
        if not rule:
            break
        check = left & prune
        worth = []
        for k in range(1, len(rule) + 1):
            hit = _covered(rule[:k], data, n) & check
            p, m = int((hit & bad).sum()), int((hit & ~bad).sum())
            worth.append(((p - m) / (p + m) if p + m else -1.0, p, -k))
        best = max(worth)
        rule = rule[: -best[2]]
        hit = _covered(rule, data, n) & left
        p, m = int((hit & bad).sum()), int((hit & ~bad).sum())
        if p < SUPPORT or p / (p + m) < PRECISION or best[0] < 2 * PRECISION - 1:
            break
        out.rules.append(tuple(rule))
        left &= ~hit
    return out


def fit(df: DataFrame, labels: DataFrame, label: str = "quality", limit: int = LABELLED, text: str = "text", doc_id: str = "doc_id", where: Column | None = None) -> DecisionList:
    """Learn from at most ``limit`` labelled documents (label 0: bad), whose statistics alone reach the driver."""
    stats = with_rates(labelled(df, labels, label, where, limit, text, doc_id), "text")
    # written once, or sorting and collecting would each compute the statistics
    kept = cut(stats.select(F.md5(F.col("doc_id").cast("string")).alias("lot"), "label", *RATES))
    rows = sorted(kept.collect())
    data = {k: np.array([r[k] for r in rows], float) for k in RATES}
    return learn(data, np.array([r["label"] == 0 for r in rows], bool))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def apply_rules(df: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """Add the statistics, ``base_failed`` and ``kept`` (false if the base rule fails, else the list's verdict).

    Null and empty texts have no words and fail. Columns of ``df`` that share a
    name with a statistic give way to it.
    """
    stats = with_rates(without(df, {*STATS, *RATES, "base_failed", "kept"} - {text}), text)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & rules.verdict())

