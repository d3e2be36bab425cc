"""Benchmark decontamination by pigeonhole edit matching.

A test item with a budget of k edits is split into k + 1 pieces: wherever the item stands in a
document with at most k edits, one piece stands there unchanged. All pieces are looked up by
one Aho-Corasick pass over a document; around each hit, Myers' bit-parallel distance of the
item to any substring decides. Texts are compared in lower case, each run of white space as
one space.

Defined cases: null or empty texts and items match nothing; items too short for an edit must
stand unchanged; repeated items and documents give a row for each pair of rows; a document
with several places of an item gives the best, the leftmost if equal; empty tables give no
rows; other columns of the inputs are ignored.
"""

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.llm.words import sliced

#: Edits allowed, as a share of an item's characters.
ERRORS = 0.05
#: Bytes of items that one pass over the documents holds; larger benchmarks take several passes.
PASS_BYTES = 8 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces_of(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def best_match(item: str, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of text nearest to item, the leftmost end if equal; by Myers' bit vectors."""
    m = len(item)
    mask, top = (1 << m) - 1, 1 << m - 1
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score = mask, 0, m
    best = (m, 0)
    for j, c in enumerate(text, 1):
        eq = where.get(c, 0)
        x = eq | down
        d0 = ((up + (x & up)) ^ up | x) & mask
        hp, hn = down | ~(d0 | up) & mask, up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        if score < best[0]:
            best = (score, j)
        hp, hn = hp << 1 & mask, hn << 1 & mask
        up, down = hn | ~(d0 | hp) & mask, hp & d0
    return best


class Matcher:
    """Items ready for the search of many texts."""

    def __init__(self, items: list[tuple[int, str]], errors: float) -> None:
        self.items = [(key, text, int(len(text) * errors)) for key, text in ((k, normal(t)) for k, t in items) if text]
        self.machine = ahocorasick.Automaton()
        uses: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, budget) in enumerate(self.items):
            for offset, piece in pieces_of(text, budget):
                uses.setdefault(piece, []).append((n, offset))
        for piece, places in uses.items():
            self.machine.add_word(piece, (len(piece), places))
        if uses:
            self.machine.make_automaton()

    def found(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item's key, edits, end) of each item in the text."""
        if not len(self.machine) or not text:
            return []
        text = normal(text)
        windows: dict[int, list[list[int]]] = {}
        for end, (length, places) in self.machine.iter(text):
            for n, offset in places:
                _, item, budget = self.items[n]
                start = end + 1 - length - offset
                lo, hi = max(0, start - budget), start + len(item) + budget
                spans = windows.setdefault(n, [])
                if spans and lo <= spans[-1][1]:
                    spans[-1][0], spans[-1][1] = min(lo, spans[-1][0]), max(hi, spans[-1][1])
                else:
                    spans.append([lo, hi])
        out = []
        for n, spans in windows.items():
            key, item, budget = self.items[n]
            near = [(d, lo + e) for lo, hi in spans for d, e in [best_match(item, text[lo:hi])] if d <= budget]
            if near:
                out.append((key, *min(near)))
        return out


def item_blocks(items: DataFrame, item_key: str) -> list[list[tuple[int, str]]]:
    """The items in blocks of about PASS_BYTES at most, one at the driver at a time for each pass."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // PASS_BYTES)
    for b in range(blocks):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64(item_key, "text"), F.lit(blocks)) == b).select(item_key, "text").collect()]


def contaminated(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", item_key: str = "item_id", errors: float = ERRORS) -> DataFrame:
    """(key, item_key, n_errors, end) of every document with a test item in it; end: in the normal form of the text."""
    schema = f"{key} long, {item_key} long, n_errors int, end int"
    result = None
    for block in item_blocks(items, item_key):

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, errors)
            for part in (p for batch in batches for p in sliced(batch)):
                rows = [(k, *hit) for k, text in zip(part.column(key).to_pylist(), part.column("text").to_pylist(), strict=True) for hit in matcher.found(text)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=[key, item_key, "n_errors", "end"])

        hits = docs.select(key, "text").mapInArrow(search, schema)
        result = hits if result is None else result.union(hits)
    return docs.sparkSession.createDataFrame([], schema) if result is None else result


def decontaminated(docs: DataFrame, items: DataFrame, *, item_key: str = "item_id", errors: float = ERRORS) -> DataFrame:
    """docs without the rows that hold a test item, judged where they are read; all columns stay."""
    for block in item_blocks(items, item_key):

        def clean(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, errors)
            for part in (p for batch in batches for p in sliced(batch)):
                yield part.filter(pa.array([not matcher.found(t) for t in part.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
