"""Bounded training samples of labelled documents."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves `part`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, parts: int, part: int, most: int) -> DataFrame:
    """(doc_id, text, label, weight) of at most `most` labelled documents a class, none held out.

    The sample is the rows whose id hashes lowest. Its bound makes the broadcast of its ids
    safe, so no text is shuffled; weight restores the classes' true shares.
    """
    usable = labels.where(F.col(target).isin(0, 1)).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), parts, part)).select("doc_id", F.col(target).cast("double").alias("label"))
    totals = usable.groupBy("label").agg(F.count("*").alias("total"))
    chosen = [usable.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0.0, 1.0)]
    sample = chosen[0].union(chosen[1]).join(F.broadcast(totals), "label").select("doc_id", "label", F.greatest(F.lit(1.0), F.col("total") / most).alias("weight"))
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
