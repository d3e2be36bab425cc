"""Token files: an adaptive context-mixing range coder in independent, checksummed blocks.

A block of at most BLOCK ids starts from an empty model. Its ids are cut into lanes of equal
length that are coded side by side as arrays and share the block's model, so every lane learns
from all of them. For each id there are three predictions: the id that last followed the two
before it (order 2), the one that last followed the one before it (order 1), each with how sure
it is, and the adaptive frequencies of all ids (order 0). Whether the first candidate, from order
2 or else order 1, is right is one decision, whose chance is a logistic mix of what each order
says of the candidate, with weights learned by context; whether order 1's other candidate is
right is the next; else the id is coded by its order-0 frequency. The model learns after steps
of all lanes, in integers alone, the same for writing and reading.

A 48-bit range coder takes each decision and emits 16-bit words. A block is MAGIC, its number of
ids, one more than the largest id and the crc32 of its ids (little-endian unsigned 32-bit
integers), then the number of words of each lane and the words; reading checks all of them. Files
hold one row a block, in order, with the documents that begin in it, and are written and
committed by Spark, so a lost executor's attempt leaves nothing behind.

Defined cases: a null or empty text is its end id alone; repeated rows and ids are written
each; null ids come first; an empty table gives empty files; other columns are ignored.
"""

import math
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairline.llm.store import kept
from fairline.llm.token_ids import encoder
from fairline.llm.words import give_back, sliced

MAGIC = b"FCM2"
HEADER = struct.Struct("<4sIII")
#: Ids of a block, lanes of a full block and ids of a lane in a smaller one.
BLOCK, LANES, LANE = 1 << 21, 8192, 256
#: A file's rows: a block each; and what is read back: a document's ids in one block.
BLOCKS = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("document", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("code", pa.binary())])
PIECES = pa.schema([("shard", pa.int32()), ("document", pa.int64()), ("block", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("doc_id", pa.int64())])
#: The range coder's words, and the least range before a word moves out.
WORD, LEAST = 16, 1 << 32
#: Chances are in parts of ONE; what an occurrence adds to an id's order-0 frequency, which begins at 1.
BITS, ONE, STEP = 12, 4096, 15
#: Slots for order 2, at most.
SLOT_BITS = 19
#: Chances and frequencies are learned after each of the first OFTEN steps, then after every EVERY-th.
OFTEN, EVERY = 8, 16
#: Contexts of a decision: sureness of order 2 and of order 1 (0 to 3) and whether they agree; classes of order-0 counts.
JOINT, CLASSES = 32, 16
SECOND, FIRST = np.arange(JOINT) // 8 * 2 + np.arange(JOINT) % 2, np.arange(JOINT) // 2 % 4 * 2 + np.arange(JOINT) % 2
STRETCH = np.array([round(256 * math.log((p + 0.5) / (ONE - p - 0.5))) for p in range(ONE)], np.int64).clip(-2047, 2047)
SQUASH = np.array([round(ONE / (1 + math.exp(-x / 256))) for x in range(-2047, 2048)], np.int64).clip(1, ONE - 1)
#: Class of an id's count so far, by its logarithm.
CLASS_OF = np.minimum(np.frexp(np.arange(1 << 14, dtype=np.float64))[1], CLASSES - 1).astype(np.uint8)


class Coder:
    """The range coder's lanes. words, ends: of all lanes one after another, and where each lane's end, if it reads."""

    def __init__(self, lanes: int, words: np.ndarray | None = None, ends: np.ndarray | None = None) -> None:
        self.range = np.full(lanes, (1 << 48) - 1, np.int64)
        self.low = np.zeros(lanes, np.int64)
        self.reads = words is not None
        self.out: list[tuple[np.ndarray, np.ndarray]] = []
        if self.reads:
            # Three zeros after each lane's words, as its writer left out.
            self.at = np.concatenate([[0], ends[:-1]]) + 3 * np.arange(lanes)
            self.words = np.zeros(len(words) + 3 * lanes, np.int64)
            self.words[np.arange(len(words)) + np.repeat(3 * np.arange(lanes), np.diff(ends, prepend=0))] = words
            for _ in range(3):
                self.low = self.low << WORD | self.taken(np.arange(lanes))

    def taken(self, lanes: np.ndarray) -> np.ndarray:
        """The next word of some lanes; only a damaged block may ask for more than there are."""
        at = self.at.take(lanes)
        self.at[lanes] = at + 1
        return self.words.take(at, mode="clip")

    def settle(self, lanes, low: np.ndarray, size: np.ndarray, rounds: int = 1) -> None:
        """Takes the new low and range of some lanes (all that have an id here, as a slice, or their numbers); a small range moves on by a word, by two at most."""
        for _ in range(rounds):
            small = np.flatnonzero(size < LEAST)
            if not len(small):
                break
            which = small if isinstance(lanes, slice) else lanes[small]
            part = low[small]
            if self.reads:
                low[small] = part << WORD | self.taken(which)
            else:
                self.out.append((which.astype(np.uint16), (part >> 32).astype(np.int32)))
                low[small] = (part & (LEAST - 1)) << WORD
            size[small] <<= WORD
        self.low[lanes], self.range[lanes] = low, size

    def bit(self, lanes, chance: np.ndarray, bit: np.ndarray | None) -> np.ndarray:
        """One decision a lane; chance: of true, in parts of ONE."""
        low, size = self.low[lanes], self.range[lanes]
        bound = (size >> BITS) * chance
        if self.reads:
            bit = low < bound
            low = low - bound * ~bit
        else:
            low = low + bound * ~bit
        self.settle(lanes, low, np.where(bit, bound, size - bound))
        return bit

    def symbol(self, lanes: np.ndarray, sums: np.ndarray, symbol: np.ndarray | None) -> np.ndarray:
        """A symbol a lane by its frequency; sums: of the frequencies before each symbol, and of all."""
        low, size = self.low.take(lanes), self.range.take(lanes)
        unit = size // int(sums[-1])
        if self.reads:
            value = np.minimum(low // unit, sums[-1] - 1).astype(np.int32)
            # Among every 64th sum first, then by halving: most of the search stays in the cache.
            symbol = (np.searchsorted(sums[::64], value, side="right") - 1) * 64
            for step in (32, 16, 8, 4, 2, 1):
                symbol += step * (sums.take(symbol + step, mode="clip") <= value)
        before = sums.take(symbol)
        start = unit * before
        self.settle(lanes, low - start if self.reads else low + start, unit * (sums.take(symbol + 1) - before), 2)
        return symbol

    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of each lane, and all words with carries taken back to the words before. One word ends a lane, as zeros follow it."""
        lanes = len(self.low)
        self.out.append((np.arange(lanes, dtype=np.uint16), (self.low + LEAST - 1 >> 32).astype(np.int32)))
        lane, word = (np.concatenate([o[i] for o in self.out]) for i in (0, 1))
        self.out.clear()
        word = word[np.argsort(lane, kind="stable")]
        while (over := np.flatnonzero(word >> WORD)).size:
            word[over] &= 0xFFFF
            word[over - 1] += 1
        return np.bincount(lane, minlength=lanes), word


class Decision:
    """Adaptive chances of one kind of decision: a logistic mix of what order 2, order 1 and order 0 say, by context."""

    def __init__(self) -> None:
        # Right and all decisions by order 2's, order 1's and order 0's own context; they begin at an even chance.
        self.seen = [np.array([[1] * n, [2] * n], np.int64) for n in (8, 8, CLASSES)]
        self.weights = np.full((3, JOINT), 26000, np.int64)

    def chances(self) -> np.ndarray:
        """The chance in each joint context and class of order-0 count, flat."""
        second, first, order0 = (STRETCH[(right * ONE - 1) // every] for right, every in self.seen)
        self.says = second[SECOND][:, None], first[FIRST][:, None], order0[None, :]
        total = sum(w[:, None] * s for w, s in zip(self.weights, self.says, strict=True)) >> 16
        self.mixed = SQUASH[np.clip(total, -2047, 2047) + 2047]
        return self.mixed.reshape(-1)

    def learn(self, contexts: list[np.ndarray], hits: list[np.ndarray]) -> None:
        """Takes what was decided in the contexts since chances()."""
        context, right = np.concatenate(contexts), np.concatenate(hits)
        every = np.bincount(context, minlength=JOINT * CLASSES).reshape(JOINT, CLASSES)
        hits = np.bincount(context[right], minlength=JOINT * CLASSES).reshape(JOINT, CLASSES)
        miss = hits * ONE - every * self.mixed
        n = np.maximum(every.sum(1), 1)
        for w, s in zip(self.weights, self.says, strict=True):
            w += (miss * s).sum(1) // n * np.minimum(n, 64) >> 14
            np.clip(w, -1 << 18, 1 << 18, out=w)
        for seen, of in zip(self.seen[:2], (SECOND, FIRST), strict=True):
            for row, x in zip(seen, (hits, every), strict=True):
                row += np.bincount(of, x.sum(1), 8).astype(np.int64)
        self.seen[2] += np.stack([hits.sum(0), every.sum(0)])
        for seen in self.seen:
            full = seen[1] > 60000
            seen[:, full] = seen[:, full] + 1 >> 1


def learned(table: np.ndarray, at: np.ndarray, held: np.ndarray, right: np.ndarray, fresh: np.ndarray) -> None:
    """The slot's prediction becomes surer if right, else less sure or the fresh one; of equal slots the last lane's counts."""
    sure = held & 3
    table[at] = np.where(right, held + (sure < 3), np.where(sure > 1, held - 1, fresh))


def lanes_of(n: int) -> tuple[int, int]:
    """Lanes of a block of n ids, and ids of the longest."""
    lanes = max(1, min(LANES, n // LANE))
    return lanes, -(-n // lanes)


def places(n: int) -> np.ndarray:
    """Where the ids of each step (row) and lane (column) are in the block; the last step's lanes without an id have none."""
    lanes, steps = lanes_of(n)
    lane = np.arange(lanes, dtype=np.int32)
    return lane * np.int32(steps - 1) + np.minimum(lane, np.int32(n - lanes * (steps - 1))) + np.arange(steps, dtype=np.int32)[:, None]


def coded(n: int, symbols: int, coder: Coder, ids: np.ndarray | None = None) -> np.ndarray:
    """Writes n ids under symbols, or reads and returns them."""
    lanes, steps = lanes_of(n)
    long = n - lanes * (steps - 1)  # lanes with an id in the last step
    at = places(n)
    grid = np.zeros(at.shape, np.int32)
    if ids is not None:
        grid[:-1], grid[-1, :long] = ids[at[:-1]], ids[at[-1, :long]]
    bits = max(12, min(SLOT_BITS, n.bit_length()))
    second, first = np.zeros(1 << bits, np.int32), np.zeros(symbols, np.int32)
    counts, sums, classes = np.zeros(symbols, np.int64), np.arange(symbols + 1, dtype=np.int32), np.zeros(symbols, np.uint8)
    one, other = Decision(), Decision()
    chances, others, seen = one.chances(), other.chances(), ([], [], [], [], [])
    last, before = np.zeros(lanes, np.int32), np.zeros(lanes, np.uint32)  # the id before, and the hash of the one before that
    for t in range(steps):
        k = lanes if t < steps - 1 else long
        some, x1 = slice(0, k), last[:k]
        own = x1.view(np.uint32) * np.uint32(0x9E3779B1)
        at2 = (own + before[:k] >> np.uint32(32 - bits)).astype(np.intp)
        held2, held1 = second.take(at2), first.take(x1)
        guess2, guess1 = held2 >> 2, held1 >> 2
        sure2 = held2 & 3
        guess = np.where(sure2 > 0, guess2, guess1)
        # Both decisions' context: sureness of both orders and whether they agree.
        joint = sure2 << 7 | (held1 & 3) << 5 | (guess1 == guess2).view(np.uint8).astype(np.int32) << 4
        context = joint | classes.take(guess)
        x = None if ids is None else grid[t, :k]
        hit = coder.bit(some, chances.take(context), None if x is None else x == guess)
        seen[0].append(context)
        seen[1].append(hit)
        y = guess if x is None else x
        left = np.flatnonzero(~hit)
        fresh, unsure = guess1.take(left), held1.take(left)
        differs = (fresh != guess.take(left)) & (unsure > 0)
        again = left[differs]
        if len(again):
            fresh = fresh[differs]
            context = joint.take(again) | classes.take(fresh)
            right = coder.bit(again, others.take(context), None if x is None else x.take(again) == fresh)
            seen[2].append(context)
            seen[3].append(right)
            if x is None:
                y[again] = fresh
            differs[differs] = right
            left = left[~differs]
        if len(left):
            found = coder.symbol(left, sums, None if x is None else x.take(left))
            if x is None:
                y[left] = found
        if x is None:
            grid[t, :k] = y
        fresh = y << 2 | 1
        learned(second, at2, held2, guess2 == y, fresh)
        learned(first, x1, held1, guess1 == y, fresh)
        before[:k], last[:k] = own * np.uint32(0x85EBCA6B), y
        seen[4].append(y)
        if t < OFTEN or t % EVERY == 0:
            one.learn(*seen[:2])
            if seen[2]:
                other.learn(*seen[2:4])
            chances, others = one.chances(), other.chances()
            counts += np.bincount(np.concatenate(seen[4]), minlength=symbols)
            np.cumsum(counts * STEP + 1, out=sums[1:])
            classes = CLASS_OF.take(np.minimum(counts, len(CLASS_OF) - 1))
            seen = ([], [], [], [], [])
    if ids is not None:
        return ids
    out = np.zeros(n, np.int32)
    out[at[:-1]], out[at[-1, :long]] = grid[:-1], grid[-1, :long]
    return out


def encoded(ids: np.ndarray) -> bytes:
    """The file form of a block of ids."""
    ids = np.asarray(ids).astype(np.int32)
    symbols = int(ids.max()) + 1
    coder = Coder(lanes_of(len(ids))[0])
    coded(len(ids), symbols, coder, ids)
    sizes, words = coder.written()
    return HEADER.pack(MAGIC, len(ids), symbols, zlib.crc32(ids.astype("<u4").tobytes())) + sizes.astype("<u2").tobytes() + words.astype("<u2").tobytes()


def decoded(block: bytes) -> np.ndarray:
    """The ids of a block; a wrong form or checksum is an error."""
    magic, n, symbols, crc = HEADER.unpack_from(block)
    lanes = lanes_of(n)[0] if n else 0
    if magic != MAGIC or not 0 < n <= BLOCK or len(block) < HEADER.size + 2 * lanes:
        raise ValueError("not a block of this format")
    words = np.frombuffer(block, "<u2", offset=HEADER.size)
    ends = np.cumsum(words[:lanes].astype(np.int64))
    if ends[-1] != len(words) - lanes:
        raise ValueError("not a block of this format: its lanes' sizes are not those of its words")
    ids = coded(n, symbols, Coder(lanes, words[lanes:], ends)).astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's ids do not have its checksum")
    return ids


def written_files(docs: DataFrame, tokenizer: str, *, shards: int | None = None) -> DataFrame:
    """Encodes docs in ascending doc_id order; the files' rows: (shard, block, n, document, doc_ids, starts, code).

    document: the number within the shard of the document that the block's first id belongs to;
    doc_ids and starts: of the documents that begin in the block. The text is shuffled once, by
    ranges of doc_id; there are as many shards as shuffle partitions, whatever the corpus, as a task streams.
    """
    docs = docs.select("doc_id", "text")
    ordered = docs.repartitionByRange(shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        shard, number, block = TaskContext.get().partitionId(), 0, 0
        held, total, doc_ids, starts = [], 0, [], []  # ids not yet coded, and the documents that begin in them

        def row(n: int) -> pa.RecordBatch:
            """The next n ids as a block."""
            nonlocal held, total, doc_ids, starts, number, block
            ids, begun = np.concatenate(held), bisect_left(starts, n)
            first = number if starts and not starts[0] else number - 1
            values = shard, block, n, first, doc_ids[:begun], starts[:begun], encoded(ids[:n])
            number, block = number + begun, block + 1
            held, total, doc_ids, starts = [ids[n:]], total - n, doc_ids[begun:], [s - n for s in starts[begun:]]
            return pa.RecordBatch.from_pylist([dict(zip(BLOCKS.names, values, strict=True))], schema=BLOCKS)

        for batch in batches:
            for part in sliced(batch):
                ids, at = tokens.encode(part.column("text"))
                doc_ids += part.column("doc_id").to_pylist()
                starts += (at[:-1] + total).tolist()
                held.append(ids)
                total += len(ids)
                while total >= BLOCK:
                    yield row(BLOCK)
        if total:
            yield row(total)
        give_back()

    return kept(ordered.mapInArrow(write, "shard int, block int, n int, document long, doc_ids array<long>, starts array<int>, code binary"), "token-files")


@lru_cache(4096)
def zeros_after(n: int) -> int:
    """x^(8n) modulo the crc's polynomial, bits reversed as zlib has them."""
    p, square = 1 << 31, 1 << 30
    n *= 8
    while n:
        if n & 1:
            p = product(square, p)
        square, n = product(square, square), n >> 1
    return p


def product(a: int, b: int) -> int:
    p, m = 0, 1 << 31
    while m:
        if a & m:
            p ^= b
        m >>= 1
        b = b >> 1 ^ 0xEDB88320 if b & 1 else b >> 1
    return p


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """crc32 of pieces in a row from (bytes, crc32) of each."""
    total = 0
    for size, crc in parts:
        total = product(zeros_after(size), total) ^ crc if total else crc
    return total


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded files.

    Blocks are decoded where they are; a document over several blocks is joined from its
    pieces' checksums, so no ids are shuffled.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                data = decoded(b["code"]).astype("<u4").tobytes()
                goes_on = not b["starts"] or b["starts"][0] > 0  # the first ids are of a document begun before
                cuts = [0] * goes_on + b["starts"] + [b["n"]]
                names = [None] * goes_on + b["doc_ids"]
                rows = [(b["shard"], b["document"] + k, b["block"], b["block"] * BLOCK + x, y - x, zlib.crc32(data[4 * x : 4 * y]), names[k]) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECES.types, strict=True)], schema=PIECES)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [joined_crc([(4 * p["n"], p["crc"]) for p in parts]) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    pieces = files.mapInArrow(read, "shard int, document long, block int, at long, n long, crc long, doc_id long")
    whole = pieces.groupBy("shard", "document").agg(F.max("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("block", "n", "crc"))).alias("parts"))
    # One row a shard; how many there are does not depend on the corpus but on the partitions asked for.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ahead = files.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return whole.join(F.broadcast(ahead), "shard").select("doc_id", (F.col("ahead") + F.col("at")).alias("start"), "n_tokens", "parts").mapInArrow(join, "doc_id long, start long, n_tokens long, ids_crc32 long")
