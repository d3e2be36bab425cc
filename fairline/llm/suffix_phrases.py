"""Phrase collocations by suffix sorting (suffix-sigma).

Each word position gives one suffix, its piece's next max_n words. Suffixes are counted where they
are read, dealt out by language and first word, and sorted in reverse lexicographic order, so that
all suffixes with a common prefix stand in a row, the longer before the shorter. One pass with a
stack of the open prefixes, one of each length, then counts every prefix; it takes arrays of rows
at a time. The frequencies of a phrase's parts are joined afterwards.

A first pass over the texts counts words by language and lists the prefixes with a set share of all
words, so the list is bounded. A suffix with such a first word is dealt out by its second word as
well, and so on; only the counts of these short prefixes are sums of several tasks'. The list
decides where a suffix goes, never what is counted.

Ranks come without a group in one task: candidates are sorted by ranges, numbered inside each
range, and the ranges before are added.

Defined cases: a null text is empty and gives nothing; a null language is `und`; repeated rows
count each; texts of any length are taken whole; a text or table without words gives no rows;
other columns of the input are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairline.llm.store import kept
from fairline.llm.words import BASE, mixed, sliced, text_arrays, words_of

MAX_N, LEAST, COVERED, TOP = 3, 10, 50, 2000
#: Bytes of text counted at a time, rows that one task sorts, about, and prefixes with one HOT-th of all words are hot.
CHUNK, TASK_ROWS, HOT = 6 << 20, 4_000_000, 2000
WORD, BLANK, BREAK = 0, 1, 2
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = BLANK
KINDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Between the words of a suffix, under all other characters; where a word has it, a tab stands, which no word has.
GAP = "\0"
LOWER[0] = 9


def word_ids(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(the distinct words, each word's number, how many words of its piece follow it)."""
    data, at = text_arrays(texts)
    kind = KINDS[data]
    solid = kind == WORD
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    cuts = at[1:-1][at[1:-1] < len(data)]
    begins[cuts] = solid[cuts]
    start = np.flatnonzero(begins)
    if not len(start):
        return pa.array([], pa.string()), np.array([], np.int64), np.array([], np.int64)
    before = np.cumsum(solid, dtype=np.int64)[start] - 1  # of the bytes of all words
    offsets = np.append(before, int(np.count_nonzero(solid))).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(LOWER[data[solid]])).dictionary_encode()
    breaks = np.unique(np.concatenate([np.flatnonzero(kind == BREAK), at[1:-1] - 0.5]))  # a text's end lies between two bytes
    piece = np.searchsorted(breaks, start)
    last = np.searchsorted(piece, piece, side="right") - 1
    return words.dictionary, words.indices.to_numpy().astype(np.int64), last - np.arange(len(start))


def hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each of some distinct words."""
    return words_of(pc.replace_substring(words, "\t", GAP)).hashes


def following(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a prefix with one more word."""
    return mixed(hashes * BASE + word)


def start_of(lang: str) -> np.uint64:
    """The hash of a prefix of no words."""
    return words_of(pa.array(["l" + "".join(f"{b:02x}" for b in lang.encode())])).hashes[0]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """(language, its texts) of about CHUNK bytes at a time; one longer text is taken alone."""
    held: list[pa.RecordBatch] = []
    size = 0

    def parts() -> Iterator[tuple[str, pa.Array]]:
        table = pa.Table.from_batches(held)
        for lang in pc.unique(table.column("lang")).to_pylist():
            yield lang, pa.concat_arrays([c.cast(pa.large_string()) for c in table.filter(pc.equal(table.column("lang"), lang)).column("text").chunks])

    for batch in batches:
        for part in sliced(batch, "text", CHUNK):
            own = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held and size + own > CHUNK:
                yield from parts()
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield from parts()


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")


def frequent_prefixes(docs: DataFrame, max_n: int) -> DataFrame:
    """(lang, words, prefix, n): words 0 for all words of a language, else the hash and count of prefixes of that many words that have one HOT-th of some chunk's words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in chunks(batches):
            words, ids, follow = word_ids(texts)
            if not len(ids):
                continue
            found = [(0, 0, len(ids))]
            least, own, at = max(16, len(ids) // HOT), hashed(words), np.arange(len(ids))
            prefix = np.full(len(ids), start_of(lang))
            for m in range(max_n - 1):
                prefix = following(prefix, own[ids[at + m]])
                kinds, back, n = np.unique(prefix, return_inverse=True, return_counts=True)
                found += [(m + 1, int(h), int(c)) for h, c in zip(kinds[n >= least].view(np.int64), n[n >= least], strict=True)]
                keep = (n[back] >= least) & (follow[at] > m)
                prefix, at = prefix[keep], at[keep]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), *(pa.array([f[k] for f in found], t) for k, t in ((0, pa.int32()), (1, pa.int64()), (2, pa.int64())))], names=["lang", "words", "prefix", "n"])

    return plain(docs).mapInArrow(count, "lang string, words int, prefix long, n long").groupBy("lang", "words", "prefix").agg(F.sum("n").alias("n"))


def counted_suffixes(texts: pa.Array, lang: str, max_n: int, hot: list[np.ndarray]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct suffixes as language and words with GAP between, their counts, how many of their prefixes are hot, and by what they are dealt out."""
    words, ids, follow = word_ids(texts)
    size, code, bound = len(words) + 1, ids + 1, len(words) + 1
    for m in range(1, max_n):
        nxt = np.zeros(len(ids), np.int64)
        nxt[: max(0, len(ids) - m)] = ids[m:] + 1
        nxt[follow < m] = 0
        if bound * size >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            bound = len(code)
        code, bound = code * size + nxt, bound * size
    _, place, count = np.unique(code, return_index=True, return_counts=True)
    own, most = hashed(words), len(ids) - 1
    prefix = following(np.full(len(place), start_of(lang)), own[ids[place]]) if len(place) else np.array([], np.uint64)
    slot, deep = prefix, np.zeros(len(place), np.int8)
    for m in range(1, max_n):
        more = (deep == m - 1) & (follow[place] >= m) & np.isin(prefix, hot[m - 1])
        deep[(deep == m - 1) & np.isin(prefix, hot[m - 1])] = m
        prefix = np.where(follow[place] >= m, following(prefix, own[ids[np.minimum(place + m, most)]]), prefix) if len(place) else prefix
        slot = np.where(more, prefix, slot)
    columns = [words.take(pa.array(ids[np.minimum(place + m, most)] if len(place) else place, mask=follow[place] < m)) for m in range(max_n)]
    front = pa.scalar(lang.replace(GAP, "\t"))
    return pc.binary_join_element_wise(front, *columns, GAP, null_handling="skip"), count, deep, slot


def dealt(docs: DataFrame, words: int, max_n: int, hot: list[np.ndarray]) -> DataFrame:
    """(suffix, n, deep): suffixes by language and first word, in reverse order; deep: prefixes of up to so many words stand in several tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in chunks(batches):
            suffix, n, deep, slot = counted_suffixes(texts, lang, max_n, hot)
            out = pa.RecordBatch.from_arrays([suffix.cast(pa.string()), pa.array(n.astype(np.int64)), pa.array(deep), pa.array((slot >> np.uint64(33)).astype(np.int32))], names=["suffix", "n", "deep", "slot"])
            for at in range(0, out.num_rows, 1 << 16):
                yield out.slice(at, 1 << 16)

    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words // TASK_ROWS))
    spread = plain(docs).mapInArrow(count, "suffix string, n long, deep byte, slot int").repartition(tasks, "slot")
    return spread.select("suffix", "n", "deep").sortWithinPartitions(F.desc("suffix"))


def prefix_ends(data: np.ndarray, at: np.ndarray, max_n: int) -> np.ndarray:
    """For each row and number of words where that prefix ends, 0 if the suffix is shorter; the language stands before."""
    gaps = np.flatnonzero(data == 0)
    first = np.searchsorted(gaps, at[:-1])  # the gap after the language
    many = np.searchsorted(gaps, at[1:]) - first
    ends = np.zeros((len(at) - 1, max_n), np.int64)
    for m in range(max_n):
        inner = many > m + 1
        ends[:, m] = np.where(inner, gaps[np.minimum(first + m + 1, len(gaps) - 1)], np.where(many == m + 1, at[1:], at[:-1])) - at[:-1]
    return ends


def common_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bytes each row but the first has in common with the one before."""
    n = np.minimum(np.diff(at)[1:], np.diff(at)[:-1])
    own = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(own, n)
    differ = data[np.repeat(at[1:-1], n) + place] != data[np.repeat(at[:-2], n) + place]
    return np.minimum.reduceat(np.append(np.where(differ, place, 1 << 40), 1 << 40), own)[: len(n)] if len(n) else n


def stack_counts(batches: Iterator[pa.RecordBatch], max_n: int, least: int) -> Iterator[pa.RecordBatch]:
    """(lang, words, phrase, n, whole) of all prefixes of sorted suffixes; whole counts under `least` are left out.

    The stack is the last row of the batch before and the counts of its prefixes, one of each
    length; the row goes before the next batch without a count of its own.
    """
    last, stack = None, np.zeros(max_n, np.int64)

    def rows(found: list[tuple]) -> pa.RecordBatch:
        split = [(*f.split(GAP), n, whole) for f, n, whole in found]
        lang, phrase = [x[0].replace("\t", GAP) for x in split], [" ".join(x[1:-2]).replace("\t", GAP) for x in split]
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array([len(x) - 3 for x in split], pa.int32()), pa.array(phrase, pa.string()), pa.array([x[-2] for x in split], pa.int64()), pa.array([x[-1] for x in split], pa.bool_())], names=["lang", "words", "phrase", "n", "whole"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held = 0 if last is None else 1
        suffixes = pa.concat_arrays([last[0], batch.column("suffix")]) if held else batch.column("suffix")
        n, deep = ((np.concatenate([a, b]) if held else b) for a, b in ((last[1] if held else None, batch.column("n").to_numpy()), (last[2] if held else None, batch.column("deep").to_numpy())))
        data, at = text_arrays(suffixes)
        ends, total = prefix_ends(data, at, max_n), np.concatenate([[0], np.cumsum(n)])
        common = np.concatenate([[-1], common_starts(data, at)])
        before, out = np.roll(ends, 1, 0), []
        for m in range(max_n):
            has = ends[:, m] > 0
            new = np.flatnonzero(~(has & (before[:, m] == ends[:, m]) & (common >= ends[:, m])))  # rows whose prefix is not that of the row before
            counts = np.diff(np.append(total[new], total[-1]))
            if held:
                counts[0] += stack[m]
            stack[m] = counts[-1]  # the last run may go on
            done = np.arange(len(new) - 1)
            whole = deep[new[done]] <= m
            done = done[has[new[done]] & (~whole | (counts[done] >= least))]
            raw = data.tobytes() if len(done) else b""
            out += [(raw[at[r] : at[r] + ends[r, m]].decode(), c, w) for r, c, w in zip(new[done].tolist(), counts[done].tolist(), (deep[new[done]] <= m).tolist(), strict=True)]
        last = suffixes[-1:], np.zeros(1, np.int64), deep[-1:]
        if out:
            yield rows(out)
    if last is not None:
        data, at = text_arrays(last[0])
        ends = prefix_ends(data, at, max_n)[0]
        if out := [(data[:e].tobytes().decode(), int(c), bool(last[2][0] <= m)) for m, (e, c) in enumerate(zip(ends, stack, strict=True)) if e and (last[2][0] > m or c >= least)]:
            yield rows(out)


def phrase_counts(docs: DataFrame, *, max_n: int = MAX_N, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, n) of all phrases of at most max_n words that occur `least` times, and (lang, n) of all words."""
    prefixes = kept(frequent_prefixes(docs, max_n), "frequent")
    totals = prefixes.where("words = 0").select("lang", "n")
    words = totals.agg(F.sum("n")).first()[0] or 0
    rows = prefixes.where((F.col("words") > 0) & (F.col("n") >= max(HOT, -(-words // HOT)))).select("words", "prefix").collect()
    hot = [np.array([r.prefix for r in rows if r.words == m], np.int64).view(np.uint64) for m in range(1, max_n)]
    counted = kept(dealt(docs, words, max_n, hot).mapInArrow(lambda batches: stack_counts(batches, max_n, least), "lang string, words int, phrase string, n long, whole boolean"), "prefixes")
    sums = counted.where("NOT whole").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return counted.where("whole").select("lang", "words", "phrase", "n").union(sums), totals


def scored(counts: DataFrame, covered: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer candidate covers."""
    candidates = counts.where("words >= 2").withColumnRenamed("n", "a")
    cuts = candidates.withColumn("k", F.explode(F.expr("sequence(1, words - 1)"))).withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - words)"))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    parts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("CAST((CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0)) * 1000000BD) div (CAST(l AS DECIMAL(16,0)) * CAST(r AS DECIMAL(16,0))) AS BIGINT)")
    best = parts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = F.expr("flatten(transform(sequence(2, words - 1), w -> transform(sequence(1, words - w + 1), s -> array_join(slice(split(phrase, ' '), s, w), ' '))))")
    longer = candidates.where("words >= 3").select("lang", F.explode(inside).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return best.join(longer, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {covered} * a").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def numbered(rows: DataFrame) -> DataFrame:
    """rows in order of rank by ranges; part: the range, place: from 1 inside language and range."""
    order = [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = rows.schema.add("part", "integer").add("place", "long")
    names = schema.names

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, lang, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("lang")
            change = np.append(True, pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False))
            at = np.arange(batch.num_rows)
            head = np.maximum.accumulate(np.where(change, at, 0))
            place = at - head + 1
            if column[0].as_py() == lang:
                place[head == 0] += seen
            lang, seen = column[-1].as_py(), int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), part, np.int32)), pa.array(place)], names=names)

    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(number, schema)


def collocations(docs: DataFrame, *, max_n: int = MAX_N, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score."""
    counts, totals = phrase_counts(docs, max_n=max_n, least=least)
    placed = kept(numbered(kept(scored(counts, covered), "scored")), "numbered")
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = placed.groupBy("lang", "part").agg(F.max("place").alias("size")).select("lang", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ahead"))
    first = placed.where(F.col("place") <= top).join(ahead, ["lang", "part"]).withColumn("rank", F.col("ahead") + F.col("place")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The query's rows in DuckDB SQL.
ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM d),
g AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
h AS (SELECT lang, ws, i, unnest(range(1, 4)) AS k FROM g),
f AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, k, count(*) AS c FROM h WHERE i + k - 1 <= len(ws) GROUP BY ALL),
t AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k AS words, c AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND c >= 10),
x AS (SELECT lang, phrase, a, ws, unnest(range(1, len(ws))) AS cut FROM c),
y AS (SELECT x.lang, x.phrase, a, cut, l.c AS l, r.c AS r, (1000000::HUGEINT * a * a) // (l.c::HUGEINT * r.c) AS score
      FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(ws[1:cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
b AS (SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM c WHERE words = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM c WHERE words = 3),
m AS (SELECT lang, phrase, max(a) AS longer FROM b GROUP BY lang, phrase),
k AS (SELECT z.* FROM z LEFT JOIN m ON z.lang = m.lang AND z.phrase = m.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM k JOIN t ON k.lang = t.lang
QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
