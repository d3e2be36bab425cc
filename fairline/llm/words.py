"""Words of whole texts as arrays: bounds and 64-bit hashes, many documents at a time.

A word is a run of bytes other than the six ASCII white-space characters. Texts are taken as
UTF-8, so a word's bytes are its characters' and nothing is decoded.
"""

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text held as arrays at a time, several of eight bytes a byte; one longer document is taken alone.
SLICE = 1 << 19
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, np.uint64)
#: The same with A-Z as a-z.
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.roll(TABLE, -32), TABLE)
BASE = np.uint64(0x9E3779B97F4A7C15)
#: What tasks have left in this process for the next ones of their kind; each entry empties one cache.
HELD: list[Callable[[], None]] = []
POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(1023, BASE)]))


def let_go() -> None:
    """Empties what tasks of another kind left in this process: Spark hands its workers on from stage to stage."""
    if not HELD:
        return
    while HELD:
        HELD.pop()()
    give_back()


def give_back() -> None:
    """Returns this process's free memory to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's alone
        trim(0)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


@dataclass
class Words:
    """data: bytes; texts: where each text begins and the last ends; start, end: of each word; first: each text's first word, and the number of words; hashes."""

    data: np.ndarray
    texts: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def text_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text begins and the last ends; nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    everything = np.frombuffer(data, np.uint8) if data else np.array([], np.uint8)
    return everything[at[0] : at[-1]], at - at[0]


def words_of(texts: pa.Array, *, lower: bool = False, hashed: bool = True) -> Words:
    data, at = text_arrays(texts)
    solid = ~SPACES[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    cuts = at[1:-1][at[1:-1] < len(data)]
    begins[cuts] = solid[cuts]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[cuts[cuts > 0] - 1] = solid[cuts[cuts > 0] - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, at)
    hashes = np.array([], np.uint64)
    if hashed and len(start):
        length = end - start
        at_word = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(at_word, length)
        powers = POWERS if length.max() <= len(POWERS) else np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(length.max()), BASE)]))
        hashes = mixed(np.add.reduceat((LOWER if lower else TABLE)[data[solid]] * powers[place], at_word) + length.astype(np.uint64))
    return Words(data, at, start, end, first, hashes)


def sliced(batch: pa.RecordBatch, column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of rows with a bounded number of text bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + most, side="right")))
        yield batch.slice(i, j - i)
        i = j


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 have none."""
    if len(hashes) < n:
        return np.array([], np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total = total * BASE + hashes[k : len(hashes) - n + 1 + k]
    return mixed(total)
