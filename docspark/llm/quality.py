"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Statistics of each whole text (lengths, character classes, repetition, lines) come from one pass
over its bytes. A small forest is grown on labelled rows; every path from a root to a node is a
conjunctive rule. A lasso logistic regression weighs the rules, most weights become zero, and the
rest are compiled into one column expression, the score.

Fitting reads at most about ``MAX_LABELLED`` labelled rows: the ids whose hash falls under the
fraction MAX_LABELLED / labelled rows. Scoring covers all rows. Ids, languages, sources and labels
are never inputs of a score.

Defined cases: null text is the empty text; its statistics are all 0 and it has a score like any
other. Labels with a null id or value are left out; an id with several labels takes the lowest.
With labels of one class only, or none, the score is that share of 1s, or 0.5. Repeated rows score
alike, and texts with equal statistics tie; a score of just 0.5 counts as good. An empty table gives no
rows. Extra columns are ignored, or kept by ``quality_filter``.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from docspark.llm._common import fresh, materialize

MAX_LABELLED = 20_000
STATS = ["words", "word_len", "long_words", "upper", "digits", "symbols", "points", "bars", "shouts", "other_bytes", "distinct", "top_word", "line_words", "repeated_lines", "symbol_words"]
#: The bytes of each class.
SYMBOLS, POINTS = b"#&*$%@^~<>{}[]=+_\\/", b".,;:?"


def _classes() -> np.ndarray:
    """256 rows of class indicators: upper, digit, symbol, point, bar, shout, other."""
    at = np.zeros((256, 7))
    for k, members in enumerate((range(65, 91), range(48, 58), SYMBOLS, POINTS, b"|", b"!", range(128, 256))):
        at[list(members), k] = 1
    return at


CLASSES = _classes()


def statistics(text: bytes) -> list[float]:
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * len(STATS)
    share = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ CLASSES / n
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        math.log1p(len(words)), (n - text.count(b" ")) / len(words), sum(len(w) > 24 for w in words) / len(words), *share.tolist(),
        len(counts) / len(words) * math.log1p(len(words)), max(counts.values()) / len(words), math.log1p(len(words) / len(lines)), 1 - len(set(lines)) / len(lines),
        sum(w[-1] in SYMBOLS or w[-1] in b"!|" for w in words) / len(words),
    ]


@F.arrow_udf(StructType([StructField(x, DoubleType()) for x in STATS]))
def stats_udf(text: pa.Array) -> pa.Array:
    rows = np.array([statistics(t or b"") for t in text.to_pylist()], float).reshape(-1, len(STATS))
    return pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(STATS))], names=STATS)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def _paths(node, path: tuple = ()) -> list[tuple]:
    """Every conjunction (feature, below, threshold) on the way to a node of a tree."""
    out = [path] if path else []
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        for child, below in ((node.leftChild(), True), (node.rightChild(), False)):
            out += _paths(child, (*path, (split.featureIndex(), below, split.threshold())))
    return out


def _tight(path: tuple) -> tuple:
    """The path with one bound a feature and side."""
    bounds: dict = {}
    for feature, below, x in path:
        old = bounds.get((feature, below), x)
        bounds[feature, below] = min(old, x) if below else max(old, x)
    return tuple(sorted((f, b, x) for (f, b), x in bounds.items()))


class RuleEnsemble:
    """rules: tuples of (statistic, below, threshold); weights: one for each rule; bias."""

    def __init__(self, rules: list[tuple], weights: list[float], bias: float):
        self.rules, self.weights, self.bias = rules, weights, bias

    @staticmethod
    def condition(rule: tuple, stat) -> Column:
        out = F.lit(True)
        for feature, below, x in rule:
            out = out & ((stat(STATS[feature]) <= x) if below else (stat(STATS[feature]) > x))
        return out

    def score(self, stat) -> Column:
        """The compiled expression; ``stat`` gives the column of a statistic."""
        total = F.lit(float(self.bias))
        for rule, w in zip(self.rules, self.weights, strict=True):
            total = total + F.when(self.condition(rule, stat), float(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(labelled: DataFrame, trees: int = 10, depth: int = 3, lasso: float = 0.001, seed: int = 7) -> RuleEnsemble:
    """``labelled``: lid, the statistics as columns, and label (0 or 1). Equal rows give equal models,
    whatever their order: they are dealt and sorted by lid first."""
    labelled = labelled.repartition(6, "lid").sortWithinPartitions("lid", *STATS)
    data = VectorAssembler(inputCols=STATS, outputCol="x").transform(labelled).select("x", F.col("label").cast("double").alias("label"), *STATS).cache()
    n, ones = data.agg(F.count("*"), F.sum("label")).first()
    if not n or ones in (0, n):
        rate = min(0.99, max(0.01, ones / n)) if n else 0.5
        return RuleEnsemble([], [], math.log(rate / (1 - rate)))
    forest = RandomForestClassifier(featuresCol="x", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=2).fit(data)
    rules = sorted({_tight(p) for tree in forest.trees for p in _paths(tree._java_obj.rootNode())})
    stat = lambda name: F.col(name)
    indicators = data.select("label", *(F.when(RuleEnsemble.condition(r, stat), 1.0).otherwise(0.0).alias(f"r{k}") for k, r in enumerate(rules)))
    indicators = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="rules").transform(indicators).select("label", "rules")
    lr = LogisticRegression(featuresCol="rules", elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60).fit(indicators)
    kept = [(r, w) for r, w in zip(rules, lr.coefficients.toArray(), strict=True) if abs(w) > 1e-6]
    data.unpersist()
    return RuleEnsemble([r for r, _ in kept], [float(w) for _, w in kept], float(lr.intercept))


def training_labels(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(lid, label) of the training rows: labelled, not held out, about ``max_labelled`` at most."""
    own = labels.select(F.col("doc_id").cast("long").alias("lid"), F.col("quality").cast("int").alias("label")).dropna().where(~held_out("lid"))
    own = own.groupBy("lid").agg(F.min("label").alias("label"))
    fraction = min(1.0, max_labelled / max(1, own.count()))
    return own.where(F.pmod(F.xxhash64("lid"), F.lit(1_000_000)) < int(fraction * 1_000_000))


def labelled_rows(stats: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Statistics and label of the training rows."""
    own = training_labels(labels, max_labelled)
    return stats.join(own, stats["id"] == own["lid"]).select("lid", *STATS, "label")


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), stats_udf(F.col(text_col).cast("binary")).alias("s")).select("id", "s.*")


def quality_scores(docs: DataFrame, labels: DataFrame, **fit_args) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    stats = materialize(with_stats(docs))
    model = fit(labelled_rows(stats, labels), **fit_args)
    scored = stats.select(F.col("id").alias("doc_id"), F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), model.score(F.col).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def quality_filter(docs: DataFrame, labels: DataFrame, text_col: str = "text", **fit_args) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    (s,) = fresh(docs, "stats")
    own = training_labels(labels)
    # Measures of labelled texts only; what is sent to every task is bounded by MAX_LABELLED.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(own), F.col("doc_id") == F.col("lid"), "left_semi")
    model = fit(with_stats(texts).join(own, F.col("id") == F.col("lid")).select("lid", *STATS, "label"), **fit_args)
    scored = docs.withColumn(s, stats_udf(F.col(text_col).cast("binary")))
    return scored.where(model.score(lambda name: F.col(f"{s}.{name}")) >= 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))
