"""Quality classifier as a sparse rule ensemble.

Paths of shallow trees over text statistics are conjunctive rules; a lasso
logistic regression weighs them, and those that keep a weight are compiled into
one Spark column expression.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut
from .decision_list import Term
from .frames import without
from .text_stats import LABELLED, RATES, STATS, labelled, with_rates

TREES, DEPTH, SEED = 16, 3, 7
LASSO, ROUNDS = 0.001, 60
#: Labelled rows of a partition, about.
ROWS = 5_000
SPLIT = re.compile(r"^(\s*)(If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+|NaN|Infinity)\)")


@dataclass
class RuleEnsemble:
    intercept: float = 0.0
    rules: list[tuple[tuple[Term, ...], float]] = field(default_factory=list)

    def score(self) -> Column:
        """Probability of label 1 from the statistics' columns."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(_all(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def __str__(self) -> str:
        return "\n".join([f"{self.intercept:+.4f}", *(f"{w:+.4f} if {' and '.join(map(str, r))}" for r, w in self.rules)])


def _all(rule: tuple[Term, ...]) -> Column:
    out = F.lit(True)
    for term in rule:
        out = out & term.column()
    return out


def tree_paths(description: str, stats: tuple[str, ...] = RATES) -> list[tuple[Term, ...]]:
    """Every inner and leaf path of the trees of a forest's description, each once, in order."""
    found: dict[tuple[Term, ...], None] = {}
    path: list[tuple[int, Term]] = []
    for line in description.splitlines():
        m = SPLIT.match(line)
        if not m:
            if line.lstrip().startswith("Tree"):
                path = []
            continue
        depth = len(m[1])
        path = [x for x in path if x[0] < depth] + [(depth, Term(stats[int(m[3])], m[4] == ">", float(m[5])))]
        found[tuple(sorted((t for _, t in path), key=str))] = None
    return list(found)


def fit(df: DataFrame, labels: DataFrame, label: str = "quality", limit: int = LABELLED, text: str = "text", doc_id: str = "doc_id", where: Column | None = None) -> RuleEnsemble:
    """Fit on at most ``limit`` labelled documents. Without both classes the score is the share of label 1 (0.5 without rows)."""
    stats = with_rates(labelled(df, labels, label, where, limit, text, doc_id), "text").select(F.col("label").cast("double").alias("label"), *RATES)
    # few, sorted partitions: the sample is bounded, and forests of equal samples are equal
    sample = cut(stats.repartition(max(1, limit // ROWS)).sortWithinPartitions(*RATES))
    seen = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(seen) < 2 or min(seen.values()) < 4:
        total, ones = sum(seen.values()), seen.get(1.0, 0)
        share = min(max(ones / total, 0.01), 0.99) if total else 0.5
        return RuleEnsemble(math.log(share / (1 - share)))
    vectors = VectorAssembler(inputCols=list(RATES), outputCol="stats").transform(sample)
    forest = RandomForestClassifier(featuresCol="stats", labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=SEED, minInstancesPerNode=2).fit(vectors)
    paths = tree_paths(forest.toDebugString)
    if not paths:
        return RuleEnsemble(0.0)
    marked = sample.select("label", *[_all(p).cast("double").alias(f"r{k}") for k, p in enumerate(paths)])
    rules = VectorAssembler(inputCols=[f"r{k}" for k in range(len(paths))], outputCol="rules").transform(marked)
    lasso = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=LASSO, maxIter=ROUNDS, standardization=False).fit(rules)
    kept = [(p, float(w)) for p, w in zip(paths, lasso.coefficients.toArray(), strict=True) if abs(w) > 1e-6]
    return RuleEnsemble(float(lasso.intercept), kept)


def apply_ensemble(df: DataFrame, ensemble: RuleEnsemble, text: str = "text") -> DataFrame:
    """Add the statistics, ``score`` and ``predicted``; null texts score as empty ones."""
    scored = with_rates(without(df, {*STATS, *RATES, "score", "predicted"} - {text}), text).withColumn("score", ensemble.score())
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
