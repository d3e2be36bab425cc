"""The op queries by name, with production parameters, and SQL where it can express them."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.llm import bit_slices, circulant_minhash, context_coder, lz_spans, quality_rules, suffix_phrases, toxic_lexicon
from fairline.llm.anchor_expansion import personal_data
from fairline.llm.circulant_minhash import near_duplicates
from fairline.llm.edit_matching import contaminated
from fairline.llm.html_text import page_texts
from fairline.llm.quartile_digest import fingerprints
from fairline.llm.slack_packing import packed
from fairline.llm.store import table
from fairline.llm.url_reputation import judged_pages
from fairline.llm.url_reputation import oracle as url_oracle

BPE = "byte_bpe_50k.json"


def op1_lz_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document once repeated windows of 35 words are removed."""
    return lz_spans.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_edit_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a test item of benchmark in it, edits allowed."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_context_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, from token files written in doc_id order and read back."""
    return context_coder.read_files(context_coder.written_files(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE)))


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host reputation and rules over every row of pages; a page is bad if its label says low quality or toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.expr("CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality = 1 OR toxic = 0 THEN 0 END").alias("bad"))
    return judged_pages(table(spark, sf_dir, "pages"), labels)


def op5_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxic_lexicon.scored(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.scored(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return page_texts(table(spark, sf_dir, "pages"))


def op8_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartile digests of every document and its edited text."""
    return fingerprints(table(spark, sf_dir, "documents"))


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces packed into sequences of 1024 tokens."""
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))


def op11_bit_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors; a seventh of the labels is moved on by one."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS LONG) + 1) % 10 ELSE label END"))
    return bit_slices.hard_negatives(vectors, "key % 100 = 0")


def op12_suffix_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first phrases of two or three words."""
    return suffix_phrases.collocations(table(spark, sf_dir, "documents"))


def op13_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return personal_data(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lz_spans": op1_lz_spans,
    "op2_edit_matching": op2_edit_matching,
    "op3_context_coder": op3_context_coder,
    "op4_url_reputation": op4_url_reputation,
    "op5_toxic_lexicon": op5_toxic_lexicon,
    "op6_quality_rules": op6_quality_rules,
    "op7_html_text": op7_html_text,
    "op8_quartile_digest": op8_quartile_digest,
    "op9_circulant_minhash": op9_circulant_minhash,
    "op10_slack_packing": op10_slack_packing,
    "op11_bit_slices": op11_bit_slices,
    "op12_suffix_phrases": op12_suffix_phrases,
    "op13_anchor_expansion": op13_anchor_expansion,
}
ORACLES = {
    "op1_lz_spans": lz_spans.ORACLE,
    "op4_url_reputation": url_oracle(),
    "op9_circulant_minhash": circulant_minhash.ORACLE,
    "op11_bit_slices": bit_slices.ORACLE,
    "op12_suffix_phrases": suffix_phrases.ORACLE,
}
