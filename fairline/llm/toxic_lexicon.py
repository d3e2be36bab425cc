"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters and digits within words to the letters
that they stand for, anything else than letters to a space. The lexicon's terms, whole words
and word beginnings, are learned from a bounded labelled sample as those that mark toxic
documents, weighted by log odds. Phrases of a term's word and a neighbour that mostly stand in
clean documents are exceptions and cancel the hit. A document's hits, in total (as a logarithm)
and normalised by its length, give the score through a logistic curve fitted on the same sample.

Defined cases: a null or empty text has no hits and gets the score of none; a sample without
both classes gives an empty lexicon and every document the score of its one class (0.5 if
empty); repeated rows count each; other columns of the inputs are ignored.
"""

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairline.llm.labelled import held_out, training_rows
from fairline.llm.store import kept
from fairline.llm.words import sliced

#: Labelled documents a class that the lexicon and the curve are fitted on, at most.
SAMPLE = 5000
#: Documents that must support a term or exception phrase; its least log likelihood ratio and log odds. How many there are is bounded by the sample alone.
SUPPORT, SURE, ODDS = 4, 9.0, 2.0
BEGINNINGS = range(4, 9)
#: Look-alike letters of other alphabets, and digits and signs within words.
GLYPHS = str.maketrans(
    "асеорхуіјѕһԁԛԝгкмтвнзбαβεικνορτυχωϲϳ" + "".join(map(chr, range(0xFF41, 0xFF5B))),
    "aceopxyijshdqwrkmtbhzbabeiknoptuxwcj" + "abcdefghijklmnopqrstuvwxyz",
)
GLYPH = re.compile("[" + "".join(map(chr, GLYPHS)) + "]")
DIGITS = str.maketrans("013457@$!|", "oieastasil")
DIGIT = re.compile(r"(?<=[^\W\d_])[013457@$!|]+(?=[^\W\d_])|(?<![^\s])[013457@$]+(?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[013457@$]+(?![^\s.,;:])")
OTHER = re.compile(r"[\W\d_]+")


def folded(text: str | None) -> str:
    """The folded text between spaces."""
    text = (text or "").lower()
    if not text.isascii() and GLYPH.search(text):
        text = text.translate(GLYPHS)
    text = DIGIT.sub(lambda m: m[0].translate(DIGITS), text)
    return f" {OTHER.sub(' ', text).strip()} "


def terms_of(text: str | None) -> list[str]:
    """The distinct candidate terms: " word " and " beginning"."""
    found: set[str] = set()
    for word in set(folded(text).split()):
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in BEGINNINGS if n < len(word))
    return list(found)


@lru_cache(4)
def automaton(terms: tuple[tuple[str, float], ...]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for term, weight in terms:
        made.add_word(term, (len(term), weight))
    made.make_automaton()
    return made


def hits_of(text: str, machine: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of each word with a term; the heaviest of a word's terms counts."""
    best: dict[int, float] = {}
    for end, (length, weight) in machine.iter(text):
        start = end - length + 2
        best[start] = max(weight, best.get(start, weight))
    return [(s, text.index(" ", s), w) for s, w in sorted(best.items())]


def phrases_at(text: str, start: int, end: int) -> list[str]:
    """The hit's word with the word before and the one after."""
    before, after = text.rfind(" ", 0, max(0, start - 1)) + 1, text.find(" ", end + 1)
    return [p for p in (text[before:end] if before < start else "", text[start:after] if after > 0 else "") if p]


def measured(text: str | None, machine, exceptions: frozenset[str]) -> list[float]:
    """Total weight of the distinct words hit, by length, heaviest, and how many."""
    t = folded(text)
    hits = {t[s:e]: w for s, e, w in hits_of(t, machine) if not exceptions or not exceptions.intersection(phrases_at(t, s, e))} if len(machine) else {}
    total = sum(hits.values())
    return [math.log1p(total), total / math.sqrt(1 + t.count(" ")), max(hits.values(), default=0.0), math.log1p(len(hits))]


def log_odds(rows: DataFrame, positives: float, negatives: float) -> DataFrame:
    """rows (term, t, c) with weight, and with g, the log likelihood ratio against chance."""
    odds = F.log((F.col("t") + 0.5) / (positives + 1)) - F.log((F.col("c") + 0.5) / (negatives + 1))
    share, n = positives / (positives + negatives), F.col("t") + F.col("c")
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    return rows.withColumn("weight", odds).withColumn("g", part(F.col("t"), share) + part(F.col("c"), 1 - share))


def pruned(found: list[tuple[str, float]]) -> tuple[tuple[str, float], ...]:
    """Terms that a shorter term does not cover with as much weight."""
    weights: dict[str, float] = {}
    for term, weight in sorted(found, key=lambda x: (len(x[0]), x[0])):
        if all(weights.get(term[:n], -9.0) < weight - 1.0 for n in range(2, len(term))):
            weights[term] = weight
    return tuple(sorted(weights.items()))


def learned(train: DataFrame) -> tuple[tuple, frozenset[str], list[float], float]:
    """Lexicon, exceptions, and the curve's coefficients and intercept. train: text, label, weight."""
    count = {r[0]: (r[1], r[2]) for r in train.groupBy("label").agg(F.count("*"), F.sum("weight")).collect()}
    clean, toxic = count.get(0.0, (0, 0.0))[0], count.get(1.0, (0, 0.0))[0]
    if not clean or not toxic:
        return (), frozenset(), [0.0] * 4, 4.0 if toxic else -4.0 if clean else 0.0

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                yield pa.RecordBatch.from_arrays([pa.array([terms_of(x.as_py()) for x in part.column("text")], pa.list_(pa.string())), part.column("label")], names=["terms", "label"])

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("term").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))

    exploded = train.select("text", "label").mapInArrow(candidates, "terms array<string>, label double").select(F.explode("terms").alias("term"), "label")
    sure = log_odds(counted(exploded).where(f"t >= {SUPPORT}"), toxic, clean).where(f"g >= {SURE} AND weight >= {ODDS}")
    lexicon = pruned([(r.term, r.weight) for r in sure.select("term", "weight").collect()])

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(lexicon)
        for batch in batches:
            for part in sliced(batch):
                found = []
                for x in part.column("text"):
                    t = folded(x.as_py())
                    found.append(sorted({p for s, e, _ in hits_of(t, machine) for p in phrases_at(t, s, e)}) if len(machine) else [])
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), part.column("label")], names=["terms", "label"])

    harmless = counted(train.select("text", "label").mapInArrow(phrases, "terms array<string>, label double").select(F.explode("terms").alias("term"), "label"))
    harmless = log_odds(harmless.where(f"c >= {SUPPORT}"), toxic, clean).where(f"g >= {SURE} AND weight <= -{ODDS}")
    exceptions = frozenset(r.term for r in harmless.select("term").collect())
    measures = kept(with_measures(train, lexicon, exceptions).select(array_to_vector("measures").alias("features"), "label", "weight"), "measures")
    curve = LogisticRegression(regParam=1e-4, maxIter=50, weightCol="weight").fit(measures)
    return lexicon, exceptions, [float(c) for c in curve.coefficients], float(curve.intercept)


def with_measures(docs: DataFrame, lexicon: tuple, exceptions: frozenset[str]) -> DataFrame:
    """docs with the array column measures; the lexicon's size is bounded by the sample's."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(lexicon)
        for batch in batches:
            for part in sliced(batch):
                rows = [measured(x.as_py(), machine, exceptions) for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*part.schema.names, "measures"])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField("measures", T.ArrayType(T.DoubleType()))]))


def scored(docs: DataFrame, labels: DataFrame, *, parts: int = 5, part: int = 0, sample: int = SAMPLE) -> DataFrame:
    """docs with measures, held_out, score and predicted; only labels outside the held-out part train."""
    lexicon, exceptions, coefficients, intercept = learned(kept(training_rows(docs, labels, "toxic", parts, part, sample), "train"))
    total = F.lit(intercept)
    for i, c in enumerate(coefficients):
        total = total + F.col("measures")[i] * c
    found = with_measures(docs.drop("measures", "held_out", "score", "predicted"), lexicon, exceptions)
    return found.withColumn("held_out", held_out(F.col("doc_id"), parts, part)).withColumn("score", 1 / (1 + F.exp(-total))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
