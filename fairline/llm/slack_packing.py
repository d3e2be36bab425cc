"""Best-fit packing by minimum bin slack.

Pieces of one length are alike, so packing works on how many pieces there are of each length,
at most CAPACITY numbers whatever the corpus. A bin takes the longest piece left; a bitset
subset-sum over the lengths left finds the fullest combination for the rest; the combination
is removed as often as the lengths allow. Each piece then finds its place by its rank among
the pieces of its length.

Defined cases: a null or empty text is its end id alone; texts longer than a sequence are cut
into full pieces with the shorter one first; repeated rows and ids are packed each; an empty
table gives no rows; other columns of the input are ignored.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairline.llm.store import kept
from fairline.llm.token_ids import encoder
from fairline.llm.words import give_back, let_go, sliced

CAPACITY = 1024
#: Pieces of one share, about, if all have the same length.
SHARE = 1 << 20


def fullest(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """(length, times) of the combination of lengths left that fills the room best, by bitset subset sums."""
    reach, steps = 1, []
    everything = (1 << room + 1) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, copies = min(int(counts[length]), room // length), 1
        while left and not reach >> room & 1:
            n = min(copies, left)
            steps.append((reach, length, n))
            reach |= reach << length * n & everything
            left, copies = left - n, copies * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for before, length, n in reversed(steps):
        if not before >> at & 1:
            at -= length * n
            chosen[length] = chosen.get(length, 0) + n
    return sorted(chosen.items(), reverse=True)


def patterns(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, times)]) until no piece is left; counts: pieces by length."""
    counts, found = counts.copy(), []
    while counts.any():
        longest = int(np.flatnonzero(counts)[-1])
        counts[longest] -= 1
        rest = dict(fullest(counts, len(counts) - 1 - longest))
        counts[longest] += 1
        rest[longest] = rest.get(longest, 0) + 1
        bins = min(int(counts[length]) // n for length, n in rest.items())
        for length, n in rest.items():
            counts[length] -= n * bins
        found.append((bins, sorted(rest.items(), reverse=True)))
    return found


def places(found: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first bin, times, offset), sorted: where the pieces of a length go from a rank on."""
    rows, used, base = [], {}, 0
    for bins, parts in found:
        offset = 0
        for length, n in parts:
            rows.append((length, used.get(length, 0), base, n, offset))
            used[length] = used.get(length, 0) + n * bins
            offset += length * n
        base += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        for batch in batches:
            for part in sliced(batch):
                ids, at = tokens.encode(part.column("text"))
                n = np.diff(at)
                pieces = -(-n // capacity)
                of = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                end = n[of] - (pieces[of] - 1 - piece) * capacity  # the first piece may be shorter
                start = np.maximum(end - capacity, 0)
                data = ids.astype("<u4", copy=False).data.cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((at[of] + start).tolist(), (at[of] + end).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(end - start), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence_id and offset.

    Ranks are taken within a length and a share by hash, and shares are put after each other, so
    a length that a third of all pieces have is ranked by many tasks. Only the count of pieces
    by length reaches the driver.
    """
    spark = docs.sparkSession
    pieces = kept(pieces_of(docs, tokenizer, capacity), "pieces")
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pieces.count() // SHARE))
    dealt = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shares)).cast("int"))
    sizes = kept(dealt.groupBy("length", "share").agg(F.count("*").alias("n")), "sizes")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in sizes.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    table = places(patterns(counts))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("inside", inside).join(offsets, ["length", "share"]).withColumn("rank", F.col("ahead") + F.col("inside") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()  # the tokenizer and what it has learned, up to some 200 MB, would stay for all later stages
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            at = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(row[:, 2] + at // row[:, 3]), pa.array(row[:, 4] + at % row[:, 3] * length)], names=[*names, "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
