"""Substring dedup by relative Lempel-Ziv factors of documents against indexed blocks.

Every window of WINDOW words has an anchor: its run of ANCHOR words with the smallest hash. The
windows of one anchor occurrence, with the words they span, are a block; block bounds depend
on content alone, so a passage is cut into the same blocks wherever it stands. The blocks of
all documents, keyed by anchor, are the index; it gives one place (document and word) of each.

A document is parsed left to right into factors, each a reference (document, word) and a length. At
a block that the index has whole the factor takes it and goes on with the next one as long as
that continues the reference. At any other block whose anchor occurs again, the factor starts at the anchor
and is extended word by word, to both sides and past the ends of blocks that agree, for as long as the
document and the index's block of that anchor agree; a factor of at least WINDOW words is a
duplicate span, in the document and at its reference. An anchor with many different blocks is dealt out in
shares, and the block that the others are held against goes to each.

At factor boundaries, where an anchor has more blocks than the two that were compared, the windows that
no factor covers are looked up among the other blocks' of that anchor. So a window is found repeated exactly if
its words start anywhere else, and each word under such a window is removed, in every occurrence.

Blocks with a set share of all occurrences are found by a list of bounded size, without a join. Texts without
a span or a boundary are not shuffled, as far as a bit map of bounded size tells them.

Defined cases: null, empty and short texts have no windows and nothing is removed; repeated
rows, with one id or several, are repeats of each other; rows are told apart by a hash of id
and text; an empty table gives no rows; other columns of the input stay as they are.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.llm.store import kept
from fairline.llm.words import BASE, Words, mixed, runs, sliced, words_of

WINDOW, ANCHOR = 35, 12
#: A block with at least one HOT-th of all occurrences is hot, so there are at most HOT of them; in a small index, one that occurs HOT_LEAST times.
HOT, HOT_LEAST = 10_000, 100
#: Blocks of one anchor in one share, bits of the map of rows, and rows sent and compared at a time.
SHARE, FILTER_BITS, SENT, COMPARED = 256, 1 << 22, 1024, 1024
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def span_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from start to end, by differences of prefix sums of a polynomial."""
    n = len(hashes)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, BASE)]))
    inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, INVERSE)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes) * powers[:n], dtype=np.uint64)])
    return mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def anchored(w: Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Of each anchor occurrence: its text, anchor hash, first and last window and the anchor's first word (word numbers), in order."""
    inside = runs(w.hashes, anchor)
    spread = window - anchor + 1
    n = len(w.hashes) - window + 1
    if n < 1:
        return (np.array([], np.int64), np.array([], np.uint64), *[np.array([], np.int64)] * 3)
    best, width = np.arange(len(inside)), 1  # place of the smallest run among the next `width`, the leftmost if equal
    while width < spread:
        step = min(width, spread - width)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(inside[right] < inside[left], right, left)
        width += step
    best = best[:n]
    text = np.searchsorted(w.first, np.arange(n), side="right") - 1
    good = np.arange(n) + window <= w.first[text + 1]
    at = np.flatnonzero(good)
    if not len(at):
        return (at, np.array([], np.uint64), at, at, at)
    best, text = best[at], text[at]
    new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(new[1:], len(at)) - 1
    return text[new], inside[best[new]], at[new], at[last], best[new]


def parts_of(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        for part in sliced(batch, column):
            yield part, words_of(part.column(column))


def indexed_blocks(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(row, anchor, block, begin, last, rel) of every block: its document's key, hashes, first and last window, and how many words stand before the anchor."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w in parts_of(batches):
            text, key, begin, last, at = anchored(w, window, anchor)
            block = span_hashes(w.hashes, begin, last + window) if len(begin) else key
            yield pa.RecordBatch.from_arrays(
                [part.column("row").take(pa.array(text)), pa.array(key.view(np.int64)), pa.array(block.view(np.int64)), pa.array((begin - w.first[text]).astype(np.int32)), pa.array((last - w.first[text]).astype(np.int32)), pa.array((at - begin).astype(np.int16))],
                names=["row", "anchor", "block", "begin", "last", "rel"],
            )

    return docs.mapInArrow(index, "row long, anchor long, block long, begin int, last int, rel short")


def judged_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks whose anchor occurs again: with how often the block occurs, a place in the smallest row it stands in, how many kinds of block its anchor has, and which is the first by hash.

    Sums are made before the shuffle, so a block of a third of all rows is one row a task.
    """
    same = kept(blocks.groupBy("anchor", "block").agg(F.count("*").alias("times"), F.min("row").alias("ref_row"), F.min_by("begin", "row").alias("ref_begin")), "blocks")
    repeated = same.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("times").alias("total"), F.min("block").alias("head")).where("total > 1").select("anchor", "kinds", "head")
    return same.join(repeated, "anchor")


def hot_blocks(blocks: DataFrame, judged: DataFrame) -> tuple[np.ndarray, ...]:
    """Block and anchor hashes and reference places of the hot blocks, at most HOT, in order of the first."""
    least = max(HOT_LEAST, -(-blocks.count() // HOT))
    rows = sorted(map(tuple, judged.where(F.col("times") >= least).select("block", "anchor", "ref_row", "ref_begin").collect()))
    return tuple(np.array([r[k] for r in rows], np.int64) for k in range(4))


def goes_on(row: np.ndarray, begin: np.ndarray, last: np.ndarray, ref_row: np.ndarray, ref_begin: np.ndarray) -> np.ndarray:
    """Whether each piece but the first continues the one before it, in its document and in the reference."""
    return (row[1:] == row[:-1]) & (begin[1:] == last[:-1] + 1) & (ref_row[1:] == ref_row[:-1]) & (ref_begin[1:] - ref_begin[:-1] == begin[1:] - begin[:-1])


def hot_apart(blocks: DataFrame, hot: tuple[np.ndarray, ...]) -> DataFrame:
    """The blocks with hot: false, but runs of hot ones whose references go on are one row with hot: true and the reference.

    A passage that a third of all documents share is found here, one row a document, and its
    blocks take no part in a shuffle.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, anchor, block, begin, last = (batch.column(c).to_numpy() for c in ("row", "anchor", "block", "begin", "last"))
            known, ref_row, ref_begin = np.zeros(len(row), bool), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            if len(hot[0]):
                at = np.minimum(np.searchsorted(hot[0], block), len(hot[0]) - 1)
                known = (hot[0][at] == block) & (hot[1][at] == anchor)
                ref_row, ref_begin = hot[2][at], hot[3][at]
            follows = np.zeros(len(row), bool)
            follows[1:] = known[1:] & known[:-1] & goes_on(row, begin, last, ref_row, ref_begin)
            head = np.flatnonzero(~follows)  # every block that is not hot, and the first of each run
            tail = np.append(head[1:], len(row)) - 1
            columns = row[head], anchor[head], block[head], begin[head], last[tail], known[head], ref_row[head], ref_begin[head].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["row", "anchor", "block", "begin", "last", "hot", "ref_row", "ref_begin"])

    return blocks.mapInArrow(split, "row long, anchor long, block long, begin int, last int, hot boolean, ref_row long, ref_begin int")


def whole_blocks(blocks: DataFrame, judged: DataFrame) -> DataFrame:
    """(row, begin, last, ref_row, ref_begin) of every block that the index has whole more than once."""
    names = ["row", "begin", "last", "ref_row", "ref_begin"]
    apart = hot_apart(blocks, hot_blocks(blocks, judged))
    rare = apart.where("NOT hot").select("row", "anchor", "block", "begin", "last").join(judged.where("times > 1").select("anchor", "block", "ref_row", "ref_begin"), ["anchor", "block"])
    return apart.where("hot").select(*names).union(rare.select(*names))


def parsed(pieces: DataFrame, *, spans: bool = False) -> DataFrame:
    """(row, begin, last, ref_row, ref_begin) of every factor: its first and last window and its reference, in one pass over each document's pieces in order.

    spans: factors that follow each other without a gap are one row, with the first one's reference.
    """
    names = ["row", "begin", "last", "ref_row", "ref_begin"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda x: pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=names)
        held = span = None  # the factor, and the span of factors, that the next batch may continue

        def joined(x: list[np.ndarray]) -> list[np.ndarray]:
            nonlocal span
            x = x if span is None else [np.concatenate([a, b]) for a, b in zip(span, x, strict=True)]
            if not len(x[0]):
                return x
            head = np.flatnonzero(np.append(True, (x[0][1:] != x[0][:-1]) | (x[1][1:] > x[2][:-1] + 1)))
            x = [np.append(c[head[1:] - 1], c[-1:]) if k == 2 else c[head] for k, c in enumerate(x)]
            span = [c[-1:] for c in x]
            return [c[:-1] for c in x]

        for batch in batches:
            if not batch.num_rows:
                continue
            x = [batch.column(c).to_numpy() for c in names]
            x = x if held is None else [np.concatenate([a, b]) for a, b in zip(held, x, strict=True)]
            same = np.append(False, x[0][1:] == x[0][:-1])
            furthest = np.maximum.accumulate(np.cumsum(~same) << 32 | x[2])  # in its row so far
            keep = ~same
            keep[1:] |= x[2][1:] > (furthest[:-1] & 0xFFFFFFFF)  # the others are inside of what is parsed; equal rows share their key
            x = [c[keep] for c in x]
            over = np.append(0, np.where(x[0][1:] == x[0][:-1], np.maximum(x[2][:-1] + 1 - x[1][1:], 0), 0)).astype(np.int32)
            x[1], x[4] = x[1] + over, x[4] + over  # a piece begins where the one before it ends
            head = np.flatnonzero(np.append(True, ~goes_on(*x)))
            x[2] = np.append(x[2][head[1:] - 1], x[2][-1:])
            x = [c if k == 2 else c[head] for k, c in enumerate(x)]
            held = [c[-1:] for c in x]
            done = [c[:-1] for c in x]
            yield out(joined(done) if spans else done)
        if held is not None:
            yield out(joined(held) if spans else held)
        if span is not None:
            yield out(span)

    return pieces.repartition("row").sortWithinPartitions("row", "begin", F.desc("last")).mapInArrow(walk, "row long, begin int, last int, ref_row long, ref_begin int")


def marked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs with `maybe`, false for most rows whose key is not wanted and for none that is, by a bit map of key hashes of at most FILTER_BITS bits."""
    bit = f"pmod(xxhash64(row), {FILTER_BITS})"
    words = wanted.groupBy(F.expr(f"{bit} div 64").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast({bit} % 64 AS int)))").alias("bits"))
    return docs.join(F.broadcast(words), F.expr(f"{bit} div 64 = word"), "left").withColumn("maybe", F.expr(f"coalesce(shiftright(bits, cast({bit} % 64 AS int)) & 1 = 1, false)")).drop("word", "bits")


def boundary_blocks(docs: DataFrame, blocks: DataFrame, judged: DataFrame, window: int) -> DataFrame:
    """One place of each distinct block whose anchor has others, with its words' hashes: row, begin, last, rel, anchor, weight (how often the block occurs), kinds, head, and share.

    A block is in one share of its anchor's, the head in all of them.
    """
    edges = judged.where("kinds > 1").select("anchor", "block", F.col("times").alias("weight"), "kinds", (F.col("block") == F.col("head")).alias("head"), F.col("ref_row").alias("row"))
    place = F.struct("begin", "last", "rel")
    only = blocks.join(edges, ["anchor", "block", "row"]).groupBy("row", "anchor", "block", "weight", "kinds", "head").agg(F.min(place).alias("w"))
    shares = F.ceil(F.col("kinds") / SHARE)
    asks = only.select("row", F.struct("w.begin", "w.last", "w.rel", "anchor", "weight", "kinds", "head", F.when(F.col("head"), shares).otherwise(1).cast("int").alias("copies"), F.when(F.col("head"), 0).otherwise(F.pmod(F.xxhash64("row", "block"), shares)).cast("int").alias("share")).alias("ask"))
    lists = asks.groupBy("row").agg(F.collect_list("ask").alias("asks"))
    names = ["begin", "last", "rel", "anchor", "weight", "kinds", "head"]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, w in parts_of(batches):
            asks = part.column("asks")
            flat = asks.flatten()
            of = np.repeat(np.arange(len(asks)), np.diff(asks.offsets.to_numpy()))
            copies, share = (flat.field(c).to_numpy() for c in ("copies", "share"))
            ask = np.repeat(np.arange(len(flat)), copies)
            share = share[ask] + np.arange(len(ask)) - np.repeat(np.cumsum(copies) - copies, copies)
            begin, last = (flat.field(c).to_numpy() for c in ("begin", "last"))
            for a in range(0, len(ask), SENT):
                some = ask[a : a + SENT]
                size = last[some] - begin[some] + window
                at = np.repeat(w.first[of[some]] + begin[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                ends = np.concatenate([[0], np.cumsum(8 * size)]).astype(np.int32)
                data = pa.BinaryArray.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(w.hashes[at].tobytes())])
                picked = flat.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([part.column("row").take(pa.array(of[some])), *(picked.field(c) for c in names), pa.array(share[a : a + SENT].astype(np.int32)), data], names=["row", *names, "share", "words"])

    texts = marked(docs.select("row", "text"), lists).where("maybe").select("row", "text").join(lists, "row")
    return texts.mapInArrow(words, "row long, begin int, last int, rel short, anchor long, weight long, kinds long, head boolean, share int, words binary")


def extensions(flat: np.ndarray, own: np.ndarray, own_rel: np.ndarray, own_n: np.ndarray, ref: np.ndarray, ref_rel: np.ndarray, ref_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the factor of each block begins and ends, in words from the block's first, if it starts at the anchor and follows its reference word by word to both sides.

    flat: all words; own, ref: where the two blocks' begin in flat; rel: words before the anchor; n: words.
    """
    left = np.minimum(own_rel, ref_rel)
    size = left + np.minimum(own_n - own_rel, ref_n - ref_rel)
    head = np.cumsum(size) - size
    step = np.arange(int(size.sum())) - np.repeat(head, size)
    differ = flat[np.repeat(own + own_rel - left, size) + step] != flat[np.repeat(ref + ref_rel - left, size) + step]
    before = np.repeat(left, size)
    start = np.maximum.reduceat(np.where(differ & (step < before), step + 1, 0), head)
    end = np.minimum.reduceat(np.where(differ & (step >= before), step, np.repeat(size, size)), head)
    return own_rel - left + start, own_rel - left + end


FOUND = "row long, begin int, last int, ref_row long, ref_begin int, anchor long, words long, weight long"


def boundary_factors(edges: DataFrame, window: int, anchor: int, extend: bool) -> DataFrame:
    """FOUND: factors at boundaries, with their first and last window and reference, and where words is not null the windows that no factor covers, to be looked up.

    Shares come sorted with their head first; every other block is extended along the head.
    """

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the head that the next batch may still need
        for batch in (some.slice(a, COMPARED) for some in batches for a in range(0, some.num_rows, COMPARED)):
            if held is not None:
                batch = pa.concat_batches([held, batch])
            key, share, row, begin, last, rel, weight, kinds = (batch.column(c).to_numpy() for c in ("anchor", "share", "row", "begin", "last", "rel", "weight", "kinds"))
            is_head = batch.column("head").to_numpy(zero_copy_only=False)
            new = np.append(True, (key[1:] != key[:-1]) | (share[1:] != share[:-1]))
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            held = batch.slice(int(first[-1]), 1)
            data = batch.column("words")
            at = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64) // 8
            flat = np.frombuffer(data.buffers()[2], np.uint64)
            n = np.diff(at)
            i = np.flatnonzero(~is_head)
            if not len(i):
                continue
            r, rel = first[i], rel.astype(np.int64)
            start, end = extensions(flat, at[i], rel[i], n[i], at[r], rel[r], n[r]) if extend else (rel[i], rel[i] + anchor)
            good = end - start >= window
            a, z, g, h = start[good], end[good] - window, i[good], r[good]
            shift = rel[h] - rel[g]
            own, ref = begin[g] + a, begin[h] + a + shift
            late = (row[g] > row[h]) | (row[g] == row[h]) & (own > ref)  # the first place of the two is its own reference
            there = np.where(late, row[h], row[g]), np.where(late, ref, own)
            spans = [np.concatenate(x) for x in ((row[g], row[h]), (own, ref), (begin[g] + z, begin[h] + z + shift), (there[0], there[0]), (there[1], there[1]))]
            # Windows outside of the factor, of anchors with blocks that were not compared.
            many = np.flatnonzero(kinds[i] > 2)
            count = n[i[many]] - window + 1
            of = np.repeat(many, count)
            place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            left = ~(good[of] & (place >= start[of]) & (place <= end[of] - window))
            of, place = of[left], place[left]
            words = span_hashes(flat, at[i[of]] + place, at[i[of]] + place + window).view(np.int64) if len(of) else np.array([], np.int64)
            whole, none = len(spans[0]), len(of)
            columns = [
                np.concatenate([spans[0], row[i[of]]]), np.concatenate([spans[1], begin[i[of]] + place]).astype(np.int32), np.concatenate([spans[2], begin[i[of]] + place]).astype(np.int32),
                np.concatenate([spans[3], np.zeros(none, np.int64)]), np.concatenate([spans[4], np.zeros(none, np.int64)]).astype(np.int32), np.concatenate([np.zeros(whole, np.int64), key[i[of]]]),
            ]
            tail = [pa.array(np.concatenate([np.zeros(whole, np.int64), words]), mask=np.arange(whole + none) < whole), pa.array(np.concatenate([np.zeros(whole, np.int64), weight[i[of]]]))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *tail], names=[c.split()[0] for c in FOUND.split(", ")])

    shares = edges.repartition("anchor", "share").sortWithinPartitions("anchor", "share", F.desc("head"))
    return shares.mapInArrow(follow, FOUND)


def pieces_of(docs: DataFrame, window: int, anchor: int, extend: bool) -> tuple[DataFrame, DataFrame]:
    """(row, begin, last, ref_row, ref_begin) of all factors, whole blocks' first; and (row, begin) of windows at their boundaries that occur again."""
    blocks = kept(indexed_blocks(docs, window, anchor), "index")
    judged = kept(judged_blocks(blocks), "judged")
    found = kept(boundary_factors(boundary_blocks(docs, blocks, judged, window), window, anchor, extend), "boundaries")
    windows = found.where("words IS NOT NULL")
    again = windows.groupBy("anchor", "words").agg(F.sum("weight").alias("times")).where("times > 1").select("anchor", "words")
    hits = windows.where("weight = 1").join(again, ["anchor", "words"], "left_semi").select("row", "begin")
    return whole_blocks(blocks, judged).union(found.where("words IS NULL").select("row", "begin", "last", "ref_row", "ref_begin")), hits


def repeated_windows(docs: DataFrame, window: int, anchor: int, *, extend: bool = True) -> DataFrame:
    """(row, begin, last): intervals of windows whose words start anywhere else as well; extend: whether factors go beyond their anchors at boundaries."""
    pieces, hits = pieces_of(docs, window, anchor, extend)
    return parsed(pieces, spans=True).select("row", "begin", "last").union(hits.select("row", "begin", F.col("begin").alias("last")))


def factors(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The parse: (row, begin, n_words, ref_row, ref_begin) of each factor that is not its own reference."""
    pieces, _ = pieces_of(with_rows(docs).select("row", "text"), window, anchor, True)
    found = parsed(pieces).where("ref_row <> row OR ref_begin <> begin")
    return found.select("row", "begin", (F.col("last") + window - F.col("begin")).alias("n_words"), "ref_row", "ref_begin")


def with_rows(docs: DataFrame) -> DataFrame:
    """The documents' id and text with a key of the row; equal rows share it."""
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def covered(n_words: int, begins: np.ndarray, lasts: np.ndarray, window: int) -> np.ndarray:
    """Which of a document's words are under the windows begins..lasts."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, lasts + window, -1)
    return np.cumsum(change[:-1]) > 0


def deduplicated(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs with repeated words removed from text, and with n_words, n_removed and kept_sha256.

    text keeps the white space around kept words; a removed run goes with the white space after it.
    Columns of docs with these names or named row are replaced.
    """
    plain = with_rows(docs.drop("n_words", "n_removed", "kept_sha256", "row", "windows", "maybe", "word", "bits"))
    spans = kept(repeated_windows(plain.select("row", "text"), window, anchor), "spans")
    lists = spans.groupBy("row").agg(F.collect_set(F.struct("begin", "last")).alias("windows"))
    names = [c for c in plain.columns if c not in ("row",)]

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                w = words_of(part.column("text"), hashed=False)
                windows, texts = part.column("windows"), part.column("text")
                out: list[tuple] = []
                for i in range(part.num_rows):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    keep = np.ones(b - a, bool)
                    text = texts[i].as_py()
                    if windows[i].is_valid:
                        at = windows[i].values
                        keep = ~covered(b - a, at.field("begin").to_numpy(), at.field("last").to_numpy(), window)
                    data = w.data[w.texts[i] : w.texts[i + 1]].tobytes()
                    if keep.all():
                        joined = b" ".join(data.split())
                    else:
                        start, end = w.start[a:b] - w.texts[i], w.end[a:b] - w.texts[i]
                        joined = b" ".join(data[s:e] for s, e in zip(start[keep].tolist(), end[keep].tolist(), strict=True))
                        reach = np.append(start[1:], len(data))
                        head = data[: start[0]]
                        cut = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
                        text = (head + b"".join(data[start[x] : reach[y - 1]] for x, y in cut.reshape(-1, 2).tolist())).decode()
                    out.append((text, b - a, int((~keep).sum()), hashlib.sha256(joined).hexdigest()))
                done = {"text": pa.array([x[0] for x in out], pa.string()), "n_words": pa.array([x[1] for x in out], pa.int64()), "n_removed": pa.array([x[2] for x in out], pa.int64()), "kept_sha256": pa.array([x[3] for x in out], pa.string())}
                yield pa.RecordBatch.from_arrays([done[c] if c in done else part.column(c) for c in (*names, "n_words", "n_removed", "kept_sha256")], names=[*names, "n_words", "n_removed", "kept_sha256"])

    schema = plain.select(*names).schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    sure = marked(plain, lists)
    touched = sure.where("maybe").drop("maybe").join(lists, "row", "left")
    untouched = sure.where("NOT maybe").drop("maybe").withColumn("windows", F.lit(None).cast(lists.schema["windows"].dataType))
    return touched.unionByName(untouched).mapInArrow(strip, schema)


#: The query's rows in DuckDB SQL.
ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^ \t-\r]+'), []) AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
t AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS j, ws FROM w WHERE len(ws) >= 35),
h AS (SELECT doc_id, j, array_to_string(ws[j:j + 34], ' ') AS words FROM t),
again AS (SELECT doc_id, j FROM h WHERE words IN (SELECT words FROM h GROUP BY words HAVING count(*) > 1)),
f AS (SELECT p.doc_id, p.j, p.word, max(CASE WHEN a.j IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.doc_id ORDER BY p.j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
      FROM p LEFT JOIN again a ON p.doc_id = a.doc_id AND p.j = a.j),
k AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY j) FILTER (WHERE gone = 0), '') AS kept FROM f GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
