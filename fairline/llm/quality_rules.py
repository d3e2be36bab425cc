"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow random trees are fitted on a bounded labelled sample; every path through them is a
conjunctive rule. A lasso logistic regression weighs the rules, most with zero, and the rules
left are compiled into one Spark column expression over the statistics.

Defined cases: a null or empty text has the statistics zero and gets a score like any other; a
sample without both classes gives every document the share of its one class (0.5 if empty);
rows without usable labels don't train; repeated rows count each; other columns of the
inputs are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairline.llm.labelled import held_out, training_rows
from fairline.llm.store import kept
from fairline.llm.trees import nested, paths
from fairline.llm.words import let_go, runs, sliced, words_of

STATISTICS = ("log_words", "word_length", "upper", "digits", "marks", "bars", "shouts", "lines", "distinct", "stutter", "repeated_runs", "high_bytes", "top_word", "stops")
#: Labelled documents a class that a classifier is fitted on, at most.
SAMPLE = 8000
CLASSES = np.zeros(256, np.uint8)
for code, chars in enumerate((bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b"|", b"!", b".", b"\n", bytes(range(128, 256)), b" \t\r\x0b\x0c"), 1):
    CLASSES[list(chars)] = code
CLASSES[[c for c in range(33, 127) if not CLASSES[c] and c not in b",'-:;?\""]] = 10


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    w = words_of(texts)
    grams = runs(w.hashes, 3)
    kinds = CLASSES[w.data]
    out = np.zeros((len(texts), len(STATISTICS)))
    for i in range(len(texts)):
        a, b, lo, hi = int(w.first[i]), int(w.first[i + 1]), int(w.texts[i]), int(w.texts[i + 1])
        n = b - a
        if not n:
            continue
        count = np.bincount(kinds[lo:hi], minlength=11)
        h = np.sort(w.hashes[a:b])
        new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        letters = max(1, int(count[1] + count[2] + count[8]))
        solid = max(1, int((w.end[a:b] - w.start[a:b]).sum()))
        g = np.sort(grams[a : b - 2]) if n > 2 else grams[:0]
        out[i] = (
            np.log1p(n), solid / n, count[1] / letters, count[3] / solid, count[10] / n, count[4] / n, count[5] / n, count[7] / n, len(new) / n,
            (w.hashes[a + 1 : b] == w.hashes[a : b - 1]).sum() / n, (g[1:] == g[:-1]).sum() / max(1, len(g)), count[8] / solid, np.diff(np.append(new, n)).max() / n, count[6] / n,
        )
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with the array column stats."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in sliced(batch):
                rows = statistics(part.column("text"))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), len(STATISTICS)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, flat], names=[*part.schema.names, "stats"])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField("stats", T.ArrayType(T.DoubleType()))]))


def rule_column(rule: tuple) -> Column:
    """1.0 where every condition of a rule holds, over the column stats."""
    holds = F.lit(True)
    for feature, sign, threshold in rule:
        value = F.col("stats")[feature]
        holds = holds & (value <= threshold if sign == "<=" else value > threshold)
    return holds.cast("double")


def fitted_rules(train: DataFrame, *, trees: int = 12, depth: int = 3, penalty: float = 0.001) -> tuple[float, list[tuple[float, tuple]]]:
    """Intercept, and the rules with a weight other than zero. train: stats, label, weight."""
    train = kept(train, "train")
    shares = {r[0]: r[1] for r in train.groupBy("label").agg(F.sum("weight")).collect()}
    if len(shares) < 2:
        return (4.0 if 1.0 in shares else -4.0 if shares else 0.0), []
    vectors = train.select(array_to_vector("stats").alias("features"), "label", "weight")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=11, weightCol="weight").fit(vectors)
    rules = sorted({p for t in forest._call_java("trees") for p in paths(nested(t.rootNode()))})
    binary = kept(train.select(array_to_vector(F.array(*map(rule_column, rules))).alias("features"), "label", "weight"), "rules")
    model = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False, weightCol="weight").fit(binary)
    return float(model.intercept), [(float(c), r) for c, r in zip(model.coefficients, rules, strict=True) if c]


def score_column(intercept: float, rules: list[tuple[float, tuple]]) -> Column:
    """The ensemble as one column expression, 0 to 1."""
    total = F.lit(intercept)
    for weight, rule in rules:
        total = total + rule_column(rule) * weight
    return 1 / (1 + F.exp(-total))


def scored(docs: DataFrame, labels: DataFrame, *, parts: int = 4, part: int = 2, sample: int = SAMPLE, cut: float = 0.7) -> DataFrame:
    """docs with stats, held_out, score and predicted; only labels outside the held-out part train."""
    train = with_statistics(training_rows(docs, labels, "quality", parts, part, sample)).select("stats", "label", "weight")
    score = score_column(*fitted_rules(train))
    found = with_statistics(docs.drop("stats", "held_out", "score", "predicted"))
    return found.withColumn("held_out", held_out(F.col("doc_id"), parts, part)).withColumn("score", score).withColumn("predicted", (F.col("score") >= cut).cast("int"))
