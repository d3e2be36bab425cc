"""Near-duplicate documents by circulant MinHash.

A document's set is its distinct five-word shingles. Two permutations give the whole
signature: the first spreads the shingles over a ring of 2^32 places, the second is read with
a circular shift by k for coordinate k. Bands of coordinates are bucket keys; a one-bit sketch
of the signature drops most false candidates; the rest are confirmed by exact Jaccard
similarity of the full sets.

Exact copies of a set are one class from the start. Within a bucket no pairs are made: every
class is held against the bucket's first, and components are built from what is confirmed; in
further rounds the classes outside of a bucket's largest component are held against a few of
that component. Only what is left outside is held against all of the bucket's other components;
the classes of a bucket with many are dealt over blocks for that, and every component comes to
each block, so no pair of a bucket is left out.

Defined cases: a null or wordless text has the empty set and is linked with nothing; fewer
words than five are one shingle; rows with one id are one node; a null id is linked with
nothing and kept; an empty table gives no rows; other columns of the input are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.llm.components import components, joined
from fairline.llm.store import kept
from fairline.llm.words import let_go, mixed, runs, sliced, words_of

SHINGLE, LEAST, OUT_OF = 5, 75, 100
BANDS, ROWS, COORDINATES = 40, 5, 256
SKETCH = [f"s{i}" for i in range(COORDINATES // 64)]
#: Sketch bits that must agree. Of two sets with similarity 0.75, 256 bits agree in 224 on average, and in fewer than 198 about once in a million.
AGREE = 198
#: Classes outside of a bucket's largest component that are held against its other components in one block.
LARGE = 2000
#: Rounds in which classes outside of a bucket's largest component are held against PIVOTS of its classes.
ROUNDS, PIVOTS = 1, 3
#: Classes of a group in one block, and classes held against them.
MEMBERS, SHARE = 200, 500
#: Bytes of hashes that a batch holds, about.
SENT = 4 << 20
#: Bits of the filter that keeps texts without pairs from being shuffled; its size is fixed.
FILTER_BITS = 1 << 22
SHIFTS = np.arange(COORDINATES, dtype=np.uint32)[:, None]
SEEDS = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = words_of(texts, lower=True)
    every = runs(w.hashes, SHINGLE)
    sets = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            s = np.sort(every[a : b - SHINGLE + 1])
            sets.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            sets.append(mixed(runs(w.hashes[a:b], b - a) + np.uint64(b - a)) if b > a else np.array([], np.uint64))
    return sets


def signature(s: np.ndarray) -> np.ndarray:
    """The smallest image of the set under each circular shift of the second permutation."""
    ring = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(ring), 2048):
        x = ring[i : i + 2048] + SHIFTS
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(least, x.min(1), out=least)
    return least


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in batches:
        for part in sliced(batch):
            n, first, second, bands, sketch = [], [], [], [], []
            for s in shingle_sets(part.column("text")):
                n.append(len(s))
                first.append(mixed(s).sum(dtype=np.uint64).view(np.int64))
                second.append(np.bitwise_xor.reduce(mixed(s ^ SEEDS[0])).view(np.int64) if len(s) else np.int64(0))
                if len(s):
                    rows = signature(s)
                    key = SEEDS.copy()
                    for r in rows[: BANDS * ROWS].reshape(BANDS, ROWS).T:
                        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + r)
                    bands.append(key.view(np.int64))
                    sketch.append(np.packbits(rows & 1 == 1).view(np.int64))
                else:
                    bands.append(np.array([], np.int64))
                    sketch.append(np.zeros(len(SKETCH), np.int64))
            bits = np.array(sketch)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(bands, pa.list_(pa.int64())), *(pa.array(b) for b in bits.T)],
                names=["doc_id", "n", "set_a", "set_b", "bands", *SKETCH],
            )


ALIKE = "least(x.n, y.n) * {out_of} >= greatest(x.n, y.n) * {least} AND {bits} >= {agree}".format(out_of=OUT_OF, least=LEAST, bits=" - ".join([str(COORDINATES), *(f"bit_count(x.{c} ^ y.{c})" for c in SKETCH)]), agree=AGREE)


def confirmed(wanted: DataFrame, groups: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) of each wanted class with a class of a group that is alike enough by their full sets.

    wanted: (class, group), class not in group; groups: (group, class). A class gets a link to
    each block of a group where it has one; pairs are not rows. Sets are computed where the text
    is and sent to blocks of at most about MEMBERS classes of a group and SHARE classes to hold
    against them, so no group gathers in one task.
    """
    wanted = kept(wanted.select("class", "group").distinct(), "wanted")
    if wanted.isEmpty():
        return docs.sparkSession.createDataFrame([], "a long, b long")
    members = groups.select("class", "group").join(wanted.select("group").distinct(), "group", "left_semi")
    sizes = wanted.groupBy("group").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("across")).join(members.groupBy("group").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("down")), "group")

    def to(own: str, own_name: str, every: str, every_name: str, side: int):
        mine, others = F.pmod(F.xxhash64("class"), F.col(own)).cast("int").alias(own_name), F.sequence(F.lit(0), F.col(every) - 1)
        return F.explode(F.transform(others, lambda i: F.struct("group", mine, i.alias(every_name), F.lit(side).alias("side")))).alias("to")

    cell = "to.group", "to.x", "to.y", "to.side"
    sent = (
        wanted.join(sizes, "group").select("class", to("across", "x", "down", "y", 1)).select("class", *cell)
        .union(members.join(sizes, "group").select("class", to("down", "y", "across", "x", 0)).select("class", *cell))
        .groupBy(F.col("class").alias("doc_id")).agg(F.collect_list(F.struct("group", "x", "y", "side")).alias("to"))
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        names = ["group", "x", "y", "side"]
        for batch in batches:
            for part in sliced(batch):
                to = part.column("to")
                for i, s in enumerate(shingle_sets(part.column("text"))):
                    targets, data = to[i].values, s.tobytes()
                    rows = max(1, min(256, SENT // max(1, len(data))))
                    for k in range(0, len(targets), rows):
                        some = targets.slice(k, rows)
                        yield pa.RecordBatch.from_arrays([*(some.field(c) for c in names), pa.array([part.column("doc_id")[i].as_py()] * len(some), pa.int64()), pa.array([data] * len(some), pa.binary())], names=[*names, "class", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        at, own, sets, every, owners = None, [], [], None, None
        for part in (p for batch in batches for p in sliced(batch, "hashes", SENT)):
            a_out, b_out = [], []
            for group, x, y, side, node, data in zip(*part.to_pydict().values(), strict=True):
                s = np.frombuffer(data, np.uint64)
                if at != (group, x, y):
                    at, own, sets, every = (group, x, y), [], [], None
                if not side:
                    own.append(node)
                    sets.append(s)
                    continue
                if every is None:
                    sizes = np.array([len(m) for m in sets])
                    every, owners = np.concatenate([*sets, s[:0]]), np.repeat(np.arange(len(sets)), sizes)
                found = s[np.minimum(np.searchsorted(s, every), len(s) - 1)] == every
                common = np.bincount(owners[found], minlength=len(sizes))
                alike = np.flatnonzero(OUT_OF * common >= LEAST * (sizes + len(s) - common))
                if len(alike):
                    a_out.append(own[alike[0]])
                    b_out.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    found = possible(docs.select("doc_id", "text"), sent).join(sent, "doc_id").mapInArrow(sets, "group long, x int, y int, side int, class long, hashes binary")
    return kept(found.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y", "side").mapInArrow(compare, "a long, b long"), "links")


def possible(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs without most of those whose id is not wanted, by a bit map of id hashes of at most FILTER_BITS bits."""
    bit = f"pmod(xxhash64(doc_id), {FILTER_BITS})"
    words = wanted.groupBy(F.expr(f"{bit} div 64").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast({bit} % 64 AS int)))").alias("bits"))
    return docs.join(F.broadcast(words), F.expr(f"{bit} div 64 = word")).where(F.expr(f"shiftright(bits, cast({bit} % 64 AS int)) & 1 = 1")).select("doc_id", "text")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    docs = docs.select("doc_id", "text")
    found = kept(docs.mapInArrow(features, "doc_id long, n long, set_a long, set_b long, bands array<long>, " + ", ".join(f"{c} long" for c in SKETCH)), "features")
    classes = kept(found.where("n > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("class")), "classes")
    reps = kept(found.join(classes.select(F.col("class").alias("doc_id")), "doc_id", "left_semi").where("n > 0").withColumnRenamed("doc_id", "class"), "classes")
    buckets = reps.select("class", "n", *SKETCH, F.explode("bands").alias("key"))

    heads = buckets.groupBy("key").agg(F.min("class").alias("head"), F.count("*").alias("size")).where("size > 1")
    rows = kept(buckets.join(heads, "key"), "buckets")
    # A class meets a head in one of the buckets that they share, by hash, so a head of very many classes is met in all of its buckets.
    held = rows.where("class <> head").groupBy("class", "head").agg(F.min_by("key", F.xxhash64("key", "class")).alias("key"))
    first = rows.where("class = head").select("key", "n", *SKETCH)
    star = held.join(reps.select("class", "n", *SKETCH), "class").alias("x").join(first.alias("y"), "key").where(ALIKE).select("x.class", F.col("x.head").alias("group"))
    single = reps.select("class", F.col("class").alias("group"))
    placed = components(confirmed(star, single, docs))

    rows = rows.where("size > 2").drop("head", "size")  # both classes of a smaller bucket have met
    rest = mixed_buckets(rows, placed)
    for turn in range(ROUNDS):
        if not rest.isEmpty():
            placed = joined(placed, confirmed(to_pivots(rest, turn), single, docs))
            rest = mixed_buckets(rows, placed)
    linked = placed
    if not rest.isEmpty():
        grouped = single.join(placed.withColumnRenamed("node", "class"), "class", "left").select("class", F.coalesce("component", "group").alias("group"))
        linked = joined(placed, confirmed(across(rest), grouped, docs))
    members = found.join(classes, ["set_a", "set_b", "n"], "left").join(linked.withColumnRenamed("node", "class"), "class", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "class", "doc_id")).otherwise(F.col("doc_id"))
    out = members.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows, each in one of its bucket's blocks of about LARGE, and the bucket's components, each in all of them."""
    blocks = rows.groupBy("key").agg(F.ceil(F.count("*") / LARGE).cast("int").alias("blocks"))
    one = rows.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).drop("blocks")
    every = summed(rows).join(blocks, "key").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return one, every


def with_largest(rows: DataFrame) -> DataFrame:
    """The rows of keys with several components, with the key's largest component as most."""
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("classes"))
    several = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("classes", "component")).alias("largest")).where("parts > 1")
    return kept(rows.join(several.select("key", F.col("largest.component").alias("most")), "key"), "mixed")


def mixed_buckets(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows of buckets whose classes are not one component yet."""
    placed = rows.join(linked.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    return with_largest(placed)


def to_pivots(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs of a class outside of its bucket's largest component and one of PIVOTS classes inside."""
    chosen = [F.min(F.struct(F.xxhash64("class", F.lit(turn * PIVOTS + i)).alias("order"), "class", "n", *SKETCH)) for i in range(PIVOTS)]
    pivots = rows.where("component = most").groupBy("key").agg(F.array_distinct(F.transform(F.array(*chosen), lambda p: F.struct(p["class"].alias("class"), *(p[c].alias(c) for c in ("n", *SKETCH))))).alias("pivots"))
    pairs = rows.where("component <> most").alias("x").join(pivots, "key").select("x.*", F.explode("pivots").alias("y")).alias("x").where(ALIKE.replace("y.", "x.y."))
    return pairs.select("class", F.col("y.class").alias("group"))


def summed(rows: DataFrame) -> DataFrame:
    """A bucket's components as one row each: sizes of sets, and the sketch bits that all or any of the classes have."""
    bits = [f(c).alias(f"{n}{i}") for i, c in enumerate(SKETCH) for n, f in (("every", F.bit_and), ("any", F.bit_or))]
    return rows.groupBy("key", "component").agg(F.min("n").alias("low"), F.max("n").alias("high"), *bits)


def across(rows: DataFrame) -> DataFrame:
    """(class, group): classes outside of a bucket's largest component, and the bucket's other components that may hold one alike.

    A component takes part as one row a bucket; a class that differs from too many of the sketch
    bits that all of its classes share differs from each of them. The largest component meets
    the others without blocks, as that is one row a class.
    """
    differ = " + ".join(f"bit_count(x.s{i} & ~y.any{i}) + bit_count(~x.s{i} & y.every{i})" for i in range(len(SKETCH)))
    fits = f"x.n * {OUT_OF} >= y.low * {LEAST} AND y.high * {OUT_OF} >= x.n * {LEAST} AND {differ} <= {COORDINATES - AGREE}"
    outside = rows.where("component <> most")
    largest = summed(rows.where("component = most"))
    with_most = outside.alias("x").join(largest.alias("y"), F.expr(f"x.key = y.key AND {fits}"))
    one, every = dealt(kept(outside, "outside"))
    others = one.alias("x").join(every.alias("y"), F.expr(f"x.key = y.key AND x.block = y.block AND x.component < y.component AND {fits}"))
    return with_most.select("x.class", F.col("y.component").alias("group")).union(others.select("x.class", F.col("y.component").alias("group")))


#: The query's rows in DuckDB SQL: every pair that shares a shingle, and what is reachable.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+'), []) AS ws FROM documents),
j AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS j FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) >= 5 THEN ws[j:j + 4] ELSE ws END, ' ') AS shingle FROM j),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 75 * (a.n + b.n - c)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT l.y, r.root FROM r JOIN l ON r.node = l.x),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.root, w.doc_id) AS component_id, coalesce(c.root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.node
"""
