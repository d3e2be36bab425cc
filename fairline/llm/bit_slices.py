"""Hard negatives by bit-sliced integer products.

Vectors become integers, floor(SCALE * x). The products of anchors with a block of rows are built
from the rows' bit-planes, the most significant first: after each plane the bits still to come
bound every score from below and above, and a pair is dropped as soon as its interval can't
qualify. Planes are taken for all pairs of a block while many are left, then pair by pair.

Anchors are a stated query set against all rows, in blocks of bounded size: a pass holds one block
of anchors, and each task keeps the best rows of each of them while it reads. Passes come in
twos, first the positives, then the negatives in the windows that their scores set.

Defined cases: a row takes part if its id, label and vector are not null and all its components
are finite and within the whole numbers that keep a score under 2**56; repeated rows and ids are
rows each, and other rows to each other; ties go to the smaller id; vectors of different lengths
never meet; an anchor without another row of its label gives no rows, nor does a positive without
a row in its window (a negative score has an empty one); an empty table gives no rows; other
columns of the input are ignored.
"""

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairline.llm.store import TASK_BYTES, kept

SCALE = 256
#: Positives of an anchor, negatives of a positive, and a negative's least share of the positive's score, in hundredths.
POSITIVES, NEGATIVES, LEAST = 5, 5, 80
#: Bytes of anchors in one pass, anchors and rows multiplied at a time, and numbers gathered for single pairs at a time.
PASS_BYTES, ANCHORS, ROWS, GATHERED = 16 << 20, 512, 1024, 1 << 22
#: Pairs are followed one by one once fewer than one in SPARSE is left.
SPARSE = 8
NOTHING = np.iinfo(np.int64).min


def integers(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(row, key, label, v) of the rows that take part; v: the integers as 32-bit numbers."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            flat = lists.flatten().cast(pa.float64())
            n = np.diff(lists.offsets.to_numpy())
            values = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(n)), n)
            good = np.ones(len(n), bool)
            good[of[~np.isfinite(values)]] = False
            values = np.floor(scale * np.where(np.isfinite(values), values, 0.0))
            most = np.array([isqrt((1 << 56) // max(1, k)) for k in np.unique(n).tolist()], np.float64)[np.unique(n, return_inverse=True)[1]]
            good[of[np.abs(values) > np.minimum(most[of], (1 << 31) - 1)]] = False
            ints = values[good[of]].astype(np.int32)
            at = np.concatenate([[0], np.cumsum(n[good])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(pa.array(good)) for c in ("key", "label")), pa.ListArray.from_arrays(pa.array(at), pa.array(ints))], names=["key", "label", "v"])

    known = vectors.select(F.col(key).cast("long").alias("key"), F.col("label").cast("long").alias("label"), F.col(vector).alias("vector")).where("key IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    return known.mapInArrow(whole, "key long, label long, v array<int>").select(F.monotonically_increasing_id().alias("row"), "key", "label", "v")


def products(q: np.ndarray, c: np.ndarray, wanted: Callable[..., np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the pairs of a row of q and a row of c that can't be ruled out, with exact scores.

    wanted(low, high, i, j): which pairs may still qualify, given bounds of their scores; i and j
    are None while all pairs are held, low and high then matrices.
    """
    bits = int(max(int(c.max(initial=0)), ~int(c.min(initial=0)), 0)).bit_length()
    exact = np.float32 if np.abs(q).sum(1, dtype=np.int64).max(initial=0) < 1 << 24 else np.float64
    qf = q.astype(exact)
    under, over = np.minimum(q, 0).sum(1, dtype=np.int64), np.maximum(q, 0).sum(1, dtype=np.int64)
    i = j = None
    score = -((qf @ (c < 0).astype(exact).T).astype(np.int64) << bits)  # the sign has the weight of all other planes and one
    for left in range(bits, -1, -1):
        if left < bits:
            plane = (c >> left & 1).astype(exact)
            if i is None:
                score += (qf @ plane.T).astype(np.int64) << left
            else:
                step = max(1, GATHERED // max(1, q.shape[1]))
                for a in range(0, len(i), step):
                    score[a : a + step] += np.einsum("ij,ij->i", qf[i[a : a + step]], plane[j[a : a + step]]).astype(np.int64) << left
        rest = (1 << left) - 1
        if i is None:
            keep = wanted(score + under[:, None] * rest, score + over[:, None] * rest, None, None)
            if not left or np.count_nonzero(keep) * SPARSE < keep.size:
                i, j = np.nonzero(keep)
                score = score[i, j]
        else:
            keep = wanted(score + under[i] * rest, score + over[i] * rest, i, j)
            i, j, score = i[keep], j[keep], score[keep]
    return i, j, score


class Best:
    """The best few (score, key) of each group: the highest score, the smallest key if equal."""

    def __init__(self, groups: int, most: int) -> None:
        self.score, self.key = np.full((groups, most), NOTHING), np.full((groups, most), -1)

    def add(self, group: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        if not len(group):
            return
        own = np.unique(group)
        held = self.score[own] != NOTHING
        group = np.concatenate([group, np.repeat(own, held.sum(1))])
        score, key = np.concatenate([score, self.score[own][held]]), np.concatenate([key, self.key[own][held]])
        order = np.lexsort((key, -score, group))
        group, score, key = group[order], score[order], key[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        top = place < self.score.shape[1]
        self.score[own], self.key[own] = NOTHING, -1
        self.score[group[top], place[top]], self.key[group[top], place[top]] = score[top], key[top]

    def least(self) -> np.ndarray:
        """The lowest score that each group holds once it is full, else a number under all scores."""
        return self.score[:, -1]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        group, place = np.nonzero(self.score != NOTHING)
        return group, self.score[group, place], self.key[group, place]


def blocks_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, key, label, vectors) of the rows of one length, some ROWS at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            lists = part.column("v")
            mine = np.diff(lists.offsets.to_numpy()) == width
            lists = lists.filter(pa.array(mine))
            if mine.any():
                yield (*(part.column(c).to_numpy()[mine] for c in ("row", "key", "label")), lists.flatten().to_numpy().reshape(int(mine.sum()), width))


class Anchors:
    """A block of anchors of one length; positives: their scores, if known, one column each, padded with NOTHING."""

    def __init__(self, row: np.ndarray, key: np.ndarray, label: np.ndarray, v: np.ndarray) -> None:
        self.row, self.key, self.label, self.v = row, key, label, v

    def nearest(self, batches: Iterator[pa.RecordBatch], most: int) -> Best:
        """The best rows of each anchor's label but itself."""
        best = Best(len(self.row), most)
        for row, key, label, v in blocks_of(batches, self.v.shape[1]):
            for x in np.intersect1d(label, self.label):
                them, mine = np.flatnonzero(label == x), np.flatnonzero(self.label == x)
                for at in range(0, len(mine), ANCHORS):
                    some = mine[at : at + ANCHORS]
                    other = self.row[some][:, None] != row[them][None, :]
                    least = best.least()[some]
                    full = len(them) > most  # at least `most` rows besides the anchor itself

                    def wanted(low, high, i, j, other=other, least=least, full=full):
                        if i is not None:
                            return high >= least[i]
                        if full:  # no row under the lower bounds of `most` others can be among the best
                            np.maximum(least, np.partition(np.where(other, low, NOTHING), -most, 1)[:, -most], out=least)
                        return other & (high >= least[:, None])

                    i, j, score = products(self.v[some], v[them], wanted)
                    best.add(some[i], score, key[them[j]])
        return best

    def between(self, batches: Iterator[pa.RecordBatch], low_end: np.ndarray, high_end: np.ndarray, most: int) -> Best:
        """For each anchor and window of scores (a column of the ends) the best rows of other labels inside; groups are anchor * windows + window."""
        windows = low_end.shape[1]
        best = Best(low_end.size, most)
        for row, key, label, v in blocks_of(batches, self.v.shape[1]):
            for at in range(0, len(self.row), ANCHORS):
                some = np.arange(at, min(at + ANCHORS, len(self.row)))
                other = self.label[some][:, None] != label[None, :]
                least = np.maximum(low_end[some], best.least().reshape(-1, windows)[some])
                most_of = high_end[some]

                def wanted(low, high, i, j, other=other, least=least, most_of=most_of):
                    if i is not None:
                        return ((high[:, None] >= least[i]) & (low[:, None] <= most_of[i])).any(1)
                    keep = np.zeros(low.shape, bool)
                    for k in range(windows):
                        keep |= (high >= least[:, k : k + 1]) & (low <= most_of[:, k : k + 1])
                    return keep & other

                i, j, score = products(self.v[some], v, wanted)
                inside, k = np.nonzero((score[:, None] >= least[i]) & (score[:, None] <= most_of[i]))
                best.add(some[i[inside]] * windows + k, score[inside], key[j[inside]])
        return best


def anchor_blocks(anchors: DataFrame) -> Iterator[dict[int, Anchors]]:
    """The anchors in blocks of about PASS_BYTES at most, one at the driver at a time, by their length."""
    total = anchors.agg(F.sum(F.lit(24) + 4 * F.size("v"))).first()[0] or 0
    blocks = -(-total // PASS_BYTES)
    for b in range(blocks):
        found = anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow().combine_chunks()
        lists = found.column("v").combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        yield {int(w): Anchors(*(found.column(c).to_numpy()[n == w] for c in ("row", "key", "label")), lists.filter(pa.array(n == w)).flatten().to_numpy().reshape(int((n == w).sum()), int(w))) for w in np.unique(n)}


def scanned(rows: DataFrame, best_of: Callable, schema: str, arrays: Callable) -> DataFrame:
    """What best_of(batches) of each task finds, as rows; arrays: the columns of a Best."""
    names = [c.split()[0] for c in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = arrays(best_of(batches))
        for at in range(0, len(found[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in found], names=names)

    return rows.mapInArrow(scan, schema)


def ranked(df: DataFrame, by: list[str], score: str, key: str, most: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), key))).where(F.col("rank") <= most)


def positives_of(rows: DataFrame, anchors: Anchors, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, keys) of each anchor's positives, best first, padded with NOTHING."""
    found = scanned(rows, lambda batches: anchors.nearest(batches, most), "at long, score long, key long", lambda best: best.rows())
    scores, keys = np.full((len(anchors.row), most), NOTHING), np.full((len(anchors.row), most), -1)
    top = ranked(found, ["at"], "score", "key", most).select("at", "rank", "score", "key").toArrow()
    at, rank = top.column("at").to_numpy(), top.column("rank").to_numpy() - 1
    scores[at, rank], keys[at, rank] = top.column("score").to_numpy(), top.column("key").to_numpy()
    return scores, keys


def negatives_of(rows: DataFrame, anchors: Anchors, scores: np.ndarray, keys: np.ndarray, most: int, least: int) -> DataFrame:
    """The best rows of other labels for each anchor and positive."""
    # Where there is no positive or its score is negative, no score is inside.
    high_end = np.where(scores >= 0, scores, NOTHING)
    low_end = np.where(scores >= 0, -(-least * np.maximum(scores, 0) // 100), np.iinfo(np.int64).max)
    windows = scores.shape[1]
    key, row = anchors.key, anchors.row

    def columns(best: Best) -> tuple[np.ndarray, ...]:
        group, score, negative = best.rows()
        i, k = group // windows, group % windows
        return row[i], key[i], k, keys[i, k], negative, scores[i, k], score

    schema = "anchor_row long, anchor_id long, place long, positive_id long, negative_id long, positive_score long, negative_score long"
    found = scanned(rows, lambda batches: anchors.between(batches, low_end, high_end, most), schema, columns)
    top = ranked(found, ["anchor_row", "place"], "negative_score", "negative_id", most)
    return top.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, is_anchor: str, *, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST) -> DataFrame:
    """Hard negatives of each anchor and positive; is_anchor: SQL over `key` that says which rows are anchors."""
    spark = vectors.sparkSession
    whole = integers(vectors, key, vector, scale)
    size = vectors.agg(F.sum(F.size(vector).cast("long"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * size // TASK_BYTES))
    rows = kept(whole.repartition(tasks), "integers")
    result = None
    for block in anchor_blocks(rows.where(is_anchor)):
        for anchors in block.values():
            scores, keys = positives_of(rows, anchors, positives)
            found = kept(negatives_of(rows, anchors, scores, keys, negatives, least), "negatives")
            result = found if result is None else result.union(found)
    return spark.createDataFrame([], RESULT) if result is None else result


#: The query's rows in DuckDB SQL.
ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""
