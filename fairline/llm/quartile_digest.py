"""Document fingerprints: quartile bucket digests of hashed byte triplets.

The byte triplets of a text's UTF-8 form are hashed to 256 buckets; the digest states for each
bucket in which quartile of the bucket counts it falls (two bits), and the length on a log
scale. Two digests differ by the summed steps between bucket codes over the summed larger
codes, plus a bounded share for the lengths; likeness is one minus that, from 0 to 1.

Defined cases: a null text is empty; texts under three bytes have the digest of no triplets;
equal texts have equal digests and likeness 1; the document after the last is the first, so a
single document is its own successor; equal ids are ordered by a hash of their texts; null ids
come last; an empty table gives no rows; other columns of the input are ignored.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 256
LENGTH_SHARE, LENGTH_SPAN = 0.1, 24


def digest_codes(data: bytes) -> np.ndarray:
    """The quartile code (0 to 3) of each bucket, then the length code."""
    a = np.frombuffer(data, np.uint8)
    length = min(255, int(math.log1p(len(a)) * 10))
    if len(a) < 3:
        return np.append(np.zeros(BUCKETS, np.uint8), np.uint8(length))
    counts = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(a) - 2, 1 << 20):  # bounds memory on very long texts
        x = a[i : i + (1 << 20) + 2].astype(np.uint32)
        counts += np.bincount(((x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(24), minlength=BUCKETS)
    q = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return np.append((counts[:, None] > q).sum(1).astype(np.uint8), np.uint8(length))


def digest_text(codes: np.ndarray) -> str:
    """Hex form: length, then four buckets a byte."""
    c = codes[:BUCKETS].reshape(-1, 4)
    return f"{codes[BUCKETS]:02x}" + (c[:, 0] << 6 | c[:, 1] << 4 | c[:, 2] << 2 | c[:, 3]).astype(np.uint8).tobytes().hex()


def parsed(text: str) -> np.ndarray:
    """The codes of a digest's hex form."""
    b = np.frombuffer(bytes.fromhex(text), np.uint8)
    return np.append(np.stack([b[1:] >> s & 3 for s in (6, 4, 2, 0)], 1).reshape(-1), b[0])


def difference(a: np.ndarray, b: np.ndarray) -> float:
    """Bounded difference score of two digests' codes, 0 to 1."""
    x, y = a[:BUCKETS].astype(np.int16), b[:BUCKETS].astype(np.int16)
    most = int(np.maximum(x, y).sum())
    steps = int(np.abs(x - y).sum()) / most if most else 0.0
    return (1 - LENGTH_SHARE) * steps + LENGTH_SHARE * min(1.0, abs(int(a[BUCKETS]) - int(b[BUCKETS])) / LENGTH_SPAN)


def edited_text(text: str, after: str) -> str:
    """text with its last third replaced by the beginning of the document after it."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def with_successor(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, tail, at, tie, doc_id, text): documents dealt out by ranges of doc_id; each block
    also holds, as tail, what follows its last document in descending order."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).alias("at"))
    ids = docs.select("at")
    cuts = np.unique(np.array(ids.select(F.col("at").cast("double")).approxQuantile("at", [i / blocks for i in range(1, blocks)], 0.25 / blocks), np.float64)).astype(np.int64) if blocks > 1 else np.array([], np.int64)

    def block_of(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(cuts, at, side="right")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(block_of(batch.column(0).to_numpy(zero_copy_only=False)), pa.int32()), batch.column(0)], names=["block", "at"])

    # One row a block.
    tops = {r[0]: r[1] for r in ids.mapInArrow(deal, "block int, at long").groupBy("block").agg(F.max("at")).collect()}
    order = sorted(tops)
    tail_of = {tops[b]: order[(i + 1) % len(order)] for i, b in enumerate(order)}  # block b's first document follows the last of the next higher block
    marks = np.array(sorted(tail_of), np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "tail", "at", "doc_id", "text"]
        for batch in batches:
            at = batch.column("at").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(block_of(at), pa.int32()), pa.array(np.zeros(len(at), np.int32)), batch.column("at"), batch.column("doc_id"), batch.column("text")], names=names)
            if len(rows := np.flatnonzero(np.isin(at, marks))):
                b = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array([tail_of[x] for x in at[rows]], pa.int32()), pa.array(np.ones(len(rows), np.int32)), b.column("at"), b.column("doc_id"), b.column("text")], names=names)

    return docs.mapInArrow(dealt, "block int, tail int, at long, doc_id long, text string").withColumn("tie", F.xxhash64("text"))


def fingerprints(docs: DataFrame, *, blocks: int | None = None) -> DataFrame:
    """Digest of each document and of its edited text, and likeness to the edited and the next document.

    The text is shuffled once, by ranges of doc_id, as many as there are shuffle partitions; a task streams
    its sorted rows and keeps one, so ranges need not follow the texts' bytes.
    """
    blocks = blocks or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_successor(docs, blocks).repartition(blocks, "block").sortWithinPartitions("block", "tail", F.desc("at"), "tie")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out: list[tuple] = []
            for block, tail, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("block", "tail", "doc_id", "text")), strict=True):
                own = digest_codes(text.encode()) if not tail or held and held[0] == block else None
                if held and held[0] == block:
                    _, before, was, codes = held
                    edited = edited_text(was, text).encode()
                    changed = digest_codes(edited)
                    out.append((before, len(was), hashlib.sha256(edited).hexdigest(), digest_text(codes), digest_text(changed), 1 - difference(codes, changed), 1 - difference(codes, own)))
                held = None if tail else (block, doc_id, text, own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 7, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return rows.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
