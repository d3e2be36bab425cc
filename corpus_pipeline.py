"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.

Defined cases are those of the operators; a text emptied by the third stage stays as an empty
text, so that stage drops no document.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm import lz_spans, quality_rules
from fairline.llm.circulant_minhash import near_duplicates
from fairline.llm.edit_matching import decontaminated
from fairline.llm.queries import BPE
from fairline.llm.slack_packing import packed
from fairline.llm.store import WRITTEN, forget, kept, table


def aside(docs: DataFrame) -> DataFrame:
    """docs as doc_id, text and one column of all others, so that none clashes with an operator's own."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("n"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text"))).alias("others"))


def back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """aside()'s rows with the columns of docs again."""
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"others.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    return back(quality_rules.scored(aside(docs), table(spark, sf_dir, "labels")).where("predicted = 1"), docs)


def without_repeated_rows(docs: DataFrame) -> DataFrame:
    """docs with one row of each id and text; texts are shuffled only if any row repeats, and only those that share a hash are compared."""
    hashed = docs.withColumn("row_hash", F.xxhash64("doc_id", "text"))
    again = kept(hashed.groupBy("row_hash").count().where("count > 1").select("row_hash"), "again")
    if again.isEmpty():
        return docs
    return hashed.join(again, "row_hash", "left_anti").union(hashed.join(again, "row_hash", "left_semi").dropDuplicates(["doc_id", "text"])).drop("row_hash")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, and one row of those with the same id and text."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return back(without_repeated_rows(aside(docs)).join(gone, "doc_id", "left_anti"), docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand anywhere else; n_chars, where there is one, is the new text's."""
    stripped = back(lz_spans.deduplicated(aside(docs)), docs)
    return stripped.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else stripped


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, packed into sequences."""
    return packed(docs, public_tokenizers.path(BPE))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("pack", pack)]
#: The stages with a model, signatures or a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's own tables and the documents before it are deleted once its rows are written."""
    docs, since = table(spark, sf_dir, "documents"), len(WRITTEN)
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(spark, since, but=1)
    return docs
