"""The pipeline keeps what its stages say, stage by stage."""

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from fairline.llm import quality_rules, token_ids
from fairline.llm.circulant_minhash import features
from fairline.llm.queries import BPE
from fairline.llm.store import BATCH_CONF, kept, table
from tests.conftest import SF


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert out.columns == columns and 0 < out.count() <= docs.count(), name
        assert out.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        docs = out
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_repeated_rows_keep_one_copy(spark):
    """A row that stands twice is one document, and its text is not taken for a repeat of itself."""
    text = " ".join(f"w{i}" for i in range(90))
    rows = [(1, text), (1, text), (2, " ".join(f"x{i}" for i in range(60))), (None, "a null id"), (None, "a null id"), (None, "another"), (3, None), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.createDataFrame(corpus_pipeline.near_dedup(spark, docs, SF).collect(), docs.schema)
    out = corpus_pipeline.substring_dedup(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in out) == sorted({(str(i), str(t)) for i, t in rows})


def test_quality_drops_what_the_operator_rejects(spark, monkeypatch):
    """A score between 0.5 and the operator's cut is rejected as well."""
    scores = lambda docs, labels: docs.withColumn("score", F.when(F.col("doc_id") == 1, 0.6).otherwise(0.8)).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
    monkeypatch.setattr(quality_rules, "scored", scores)
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).collect()] == [2]


CLASH = "doc_id long, text string, row long, windows string, score double, stats string, predicted int, n_words long, row_hash long, others string, kept boolean, none int"


def test_stages_with_odd_rows_and_clashing_columns(spark):
    """Nulls, empty and repeated rows, a long text, and columns named like the operators' own; other columns stay as they are."""
    rows = [(i, t, i or 0, "w", 0.5, "s", 1, 2, 3, "o", True, 4) for i, t in ((1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "a null id"), (4, "alpha beta gamma delta " * 3000), (5, " ".join(f"u{k}" for k in range(80))))]
    docs = spark.createDataFrame(rows, CLASH)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert r.row == (r.doc_id or 0) and (r.windows, r.score, r.others, r.none) == ("w", 0.5, "o", 4), name
    assert corpus_pipeline.near_dedup(spark, docs, SF).count() == 6 and corpus_pipeline.decontaminate(spark, docs, SF).count() == 7
    assert corpus_pipeline.pack(spark, docs, SF).select("doc_id").distinct().count() == 6


def test_stages_with_empty_tables(spark):
    docs = spark.createDataFrame([], CLASH)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_workers_do_not_keep_the_tokenizer():
    """A worker that has packed holds no tokenizer, nor what it has learned, once it signs texts; the next encoder is whole again."""
    texts = pa.array(["one two three", None, "four"])
    ids = token_ids.encoder(public_tokenizers.path(BPE)).encode(texts)[0].tolist()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), texts], names=["doc_id", "text"])
    assert [n for part in features(iter([batch])) for n in part.column("n").to_pylist()] == [1, 0, 1]
    assert token_ids.encoder.cache_info().currsize == 0 and token_ids.powers.cache_info().currsize == 0
    assert token_ids.encoder(public_tokenizers.path(BPE)).encode(texts)[0].tolist() == ids


def test_kept_tables_take_small_batches(spark):
    """No task holds much more than 4 MB of texts at a time, and the session's own limit stays."""
    usual = spark.conf.get(BATCH_CONF)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"]) for b in batches)
    rows = kept(spark.range(0, 2000, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("text")).mapInArrow(sizes, "n long, size long"), "sizes").collect()
    assert sum(r.n for r in rows) == 2000 and max(r["size"] for r in rows) < 5 << 20
    assert spark.conf.get(BATCH_CONF) == usual
