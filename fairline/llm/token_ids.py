"""Token ids of whole texts with the tokenizers library, unit by unit from a bounded table.

A text is cut where a byte-level pre-tokenizer always ends a piece: before a space or line feed
that follows anything but white space, after such a line feed if anything but white space follows,
and before a mark that follows an ASCII letter or digit (but a bar, which stands in special tokens). So a text's ids are those of its units in a row. Units repeat: each is
known by a 64-bit hash of its bytes, and only new ones go through the library. Cutting, hashing and
looking up are array operations on many texts at once.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from fairline.llm.words import BASE, HELD, TABLE, mixed, text_arrays

#: The id after each document's own.
END = 2
#: Units kept before the table starts anew, and ids of all of them.
UNITS_KEPT, IDS_KEPT = 2_000_000, 10_000_000
#: The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on.
PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
BYTES = {b: chr(b) for b in PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTED)}
BYTE_OF = {c: b for b, c in BYTES.items()}
#: What a byte is: SPACE or FEED, MARK (ASCII) or BAR, WORD (ASCII letter or digit), HIGH (part of another character), LEAD (begins one that is no white space).
SPACE, FEED, MARK, WORD, HIGH, LEAD, BAR = (1 << i for i in range(7))
KINDS = np.zeros(256, np.uint8)
for _b in range(256):
    KINDS[_b] = SPACE if _b == 32 else FEED if _b == 10 else (WORD if chr(_b).isalnum() else BAR if _b == 124 else MARK) if 33 <= _b < 127 else 0 if _b < 128 else HIGH | (LEAD if _b >= 0xC3 and _b not in (0xE1, 0xE2, 0xE3) else 0)


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, up to n."""
    return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, b)])) for b in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))))


def unit_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the units of texts begin; at: where each text begins and the last ends."""
    kind = KINDS[data]
    cut = np.zeros(len(data), bool)
    own, prior = kind[1:], kind[:-1]
    solid = prior & (MARK | WORD | HIGH | BAR) > 0  # but for white space of several bytes, which is looked at below
    cut[1:] = (own & (SPACE | FEED) > 0) & solid | (own & MARK > 0) & (prior & WORD > 0)
    wide = np.flatnonzero((own & (SPACE | FEED) > 0) & (prior & HIGH > 0)) + 1
    if len(wide):
        a, b, c = (data[np.maximum(wide - i, 0)] for i in (1, 2, 3))
        white = (b == 0xC2) & ((a == 0x85) | (a == 0xA0)) | (c == 0xE1) & (b == 0x9A) & (a == 0x80) | (c == 0xE3) & (b == 0x80) & (a == 0x80)
        white |= (c == 0xE2) & ((b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF)) | (b == 0x81) & (a == 0x9F))
        cut[wide[white]] = False
    cut[1:] |= cut[:-1] & (prior & FEED > 0) & (own & (MARK | WORD | LEAD | BAR) > 0)
    cut[at[:-1][at[:-1] < at[1:]]] = True
    return np.flatnonzero(cut)


class Units:
    """Hash -> number of a known unit, by open addressing."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.numbers = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each, -1 if unknown."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.intp)
        keys = self.keys.take(slot)
        out = np.where(keys == hashes, self.numbers.take(slot), -1)
        left = np.flatnonzero((keys != hashes) & (keys != 0))
        while len(left):
            slot[left] = slot[left] + 1 & len(self.keys) - 1
            keys = self.keys.take(slot[left])
            same = keys == hashes[left]
            out[left[same]] = self.numbers.take(slot[left[same]])
            left = left[~same & (keys != 0)]
        return out

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """hashes: distinct and unknown."""
        self.n += len(hashes)
        if 2 * self.n > len(self.keys):
            filled = np.flatnonzero(self.keys)
            hashes, numbers = np.concatenate([self.keys[filled], hashes]), np.concatenate([self.numbers[filled], numbers])
            self.bits = int(2 * self.n).bit_length()
            self.keys, self.numbers = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.intp)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = hashes[free]
            won = free[self.keys[slot[free]] == hashes[free]]
            self.numbers[slot[won]] = numbers[won]
            left = left[self.keys[slot[left]] != hashes[left]]
            slot[left] = slot[left] + 1 & len(self.keys) - 1


class TokenIds:
    """Ids of texts. path: a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        #: Ids that begin with a space or line feed, and whether none has one after a letter or a part of one, or a line feed before one.
        self.begins = {c: np.zeros(max(vocabulary.values()) + 1, bool) for c in "ĠĊ"}
        for c, begins in self.begins.items():
            begins[[i for t, i in vocabulary.items() if t[0] == c]] = True
        letter = lambda c: c.isalpha() or c == "\ufffd"
        texts = [bytes(BYTE_OF[c] for c in t).decode(errors="replace") for t in vocabulary if "Ġ" in t[1:] or "Ċ" in t]
        self.apart = not any(b in " \n" and letter(a) or a == "\n" and letter(b) for t in texts for a, b in zip(t, t[1:], strict=False))
        self.forget()

    def forget(self) -> None:
        self.units, self.n = Units(), 0
        self.first, self.count, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.uint32)
        self.used = 0

    def learn(self, units: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """The numbers of new units.

        Letters alone are one piece, which the library's model takes as it is, and many at a time, each
        after a space or, if it has none, a line feed, as no id goes on over those; the rest goes
        through the whole tokenizer.
        """
        words, lines, others = [], [], []
        for i, u in enumerate(units):
            text = u.decode()
            word = text[1:] if text[0] == " " else text
            if self.apart and word.isalpha():
                (words if text[0] == " " else lines).append((i, word if u.isascii() else word.encode().decode("latin1").translate(BYTES)))
            else:
                others.append((i, text))
        order, counts, parts = [i for some in (words, lines, others) for i, _ in some], [], []
        for some, before in ((words, "Ġ"), (lines, "Ċ")):
            for k in range(0, len(some), 128):
                ids = np.array([t.id for t in self.tokenizer.model.tokenize(before + before.join([w for _, w in some[k : k + 128]]))], np.uint32)
                first = self.begins[before][ids]
                drop = int(before == "Ċ")  # a line feed is an id of its own
                counts.append(np.diff(np.flatnonzero(first), append=len(ids)) - drop)
                parts.append(ids[~first] if drop else ids)
        for k in range(0, len(others), 1000):
            got = self.tokenizer.encode([t for _, t in others[k : k + 1000]], is_pretokenized=True, add_special_tokens=False)
            parts.append(np.array(got.ids, np.uint32))
            counts.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(others[k : k + 1000])))
        flat, count = np.concatenate(parts), np.concatenate(counts)
        hashes = hashes[order]
        numbers = self.n + np.arange(len(units))
        self.first, self.count, self.ids = (self.grown(x, n) for x, n in ((self.first, self.n + len(units)), (self.count, self.n + len(units)), (self.ids, self.used + len(flat))))
        self.first[numbers], self.count[numbers] = self.used + np.cumsum(count) - count, count
        self.ids[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + len(units), self.used + len(flat)
        self.units.add(hashes, numbers.astype(np.int32))
        placed = np.empty(len(units), np.int64)
        placed[order] = numbers
        return placed

    @staticmethod
    def grown(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, END after each, and where each text begins and the last ends. A null is empty."""
        data, at = text_arrays(texts)
        if self.n > UNITS_KEPT or self.used > IDS_KEPT:
            self.forget()
        n = len(data)
        start = unit_starts(data, at) if n else np.array([], np.int64)
        end = np.append(start[1:], n)[: len(start)]
        ups, downs = powers(max(1 << 20, 1 << int(n).bit_length()))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(TABLE[data] * ups[:n], out=sums[1:])
        hashes = np.maximum(mixed((sums[end] - sums[start]) * downs[start] + (end - start).astype(np.uint64)), np.uint64(1))
        number = self.units.find(hashes)
        new = np.flatnonzero(number < 0)
        if len(new):
            distinct, place, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            raw = data.tobytes()
            number[new] = self.learn([raw[a:b] for a, b in zip(start[new[place]].tolist(), end[new[place]].tolist(), strict=True)], distinct)[back]
        # Ids of the units in a row, with room for END after each text.
        count = self.count[number].astype(np.int64)
        units = np.searchsorted(start, at)
        before = np.concatenate([[0], np.cumsum(count)])[units] + np.arange(len(at))  # where texts begin
        out = np.full(int(before[-1]), END, np.uint32)
        shift = self.first[number] - (np.cumsum(count) - count)
        taken = self.ids[np.repeat(shift, count) + np.arange(int(count.sum()))]
        inside = np.ones(len(out), bool)
        inside[before[1:] - 1] = False
        out[inside] = taken
        return out, before


@lru_cache(1)
def encoder(path: str) -> TokenIds:
    """One for all tasks of a worker, so that what one has learned serves the next, until let_go()."""
    HELD.extend((encoder.cache_clear, powers.cache_clear))
    return TokenIds(path)
