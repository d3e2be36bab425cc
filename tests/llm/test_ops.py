"""Operators against brute force, direct tokenizing, held-out labels and SQL, and their defined cases."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fairline.llm import circulant_minhash, context_coder, edit_matching, html_text, lz_spans, quality_rules, quartile_digest, queries, slack_packing, token_ids, toxic_lexicon, url_reputation
from fairline.llm.store import table
from fairline.llm.token_ids import TokenIds
from fairline.llm.trees import paths
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = "alpha beta gamma delta " * 4000
#: Null and empty texts, ties, repeated rows and ids, white space, a long text, other alphabets.
ODD = [(1, None), (2, ""), (3, "  \n "), (4, "one two"), (4, "one two"), (5, "ONE two"), (6, LONG), (7, LONG), (8, " ".join(f"w{i}" for i in range(60))), (9, " ".join(f"w{i}" for i in range(60)) + " end"), (None, "null id text"), (10, "héllo  wörld 你好 \t x"), (11, "a  b   c\n\n d ")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in ODD], "doc_id long, text string, lang string, n int, row string")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}


def ids_of(text):
    t = Tokenizer.from_file(BPE)
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLES[name])


def kept_words(rows, window):
    at = defaultdict(list)
    words = [WORD.findall(t or "") for _, t in rows]
    for d, ws in enumerate(words):
        for j in range(len(ws) - window + 1):
            at[tuple(ws[j : j + window])].append((d, j))
    gone = [set() for _ in rows]
    for places in at.values():
        if len(places) > 1:
            for d, j in places:
                gone[d].update(range(j, j + window))
    return [(len(ws), len(g), hashlib.sha256(" ".join(w for j, w in enumerate(ws) if j not in g).encode()).hexdigest()) for ws, g in zip(words, gone, strict=True)]


def test_spans_of_odd_rows(odd):
    found = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in lz_spans.deduplicated(odd).collect())
    assert found == sorted((str(i), *x) for (i, _), x in zip(ODD, kept_words(ODD, lz_spans.WINDOW), strict=True))


def test_hot_blocks_are_found_like_others(spark, monkeypatch):
    monkeypatch.setattr(lz_spans, "HOT_LEAST", 3)
    shared = " ".join(f"s{i}" for i in range(90))
    rows = [(i, f"a{i} b{i} {shared} c{i} " + " ".join(f"t{i}x{k}" for k in range(i * 7))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in lz_spans.deduplicated(docs).collect())
    assert found == [(i, *x) for (i, _), x in zip(rows, kept_words(rows, lz_spans.WINDOW), strict=True)]


@pytest.mark.parametrize("hot_least", [100, 2])
def test_repeated_windows_come_from_factors(spark, monkeypatch, hot_least):
    monkeypatch.setattr(lz_spans, "HOT_LEAST", hot_least)
    shared = " ".join(f"s{i}" for i in range(400))
    other = " ".join(f"o{i}" for i in range(300))
    rows = [(1, f"a b c {shared} d"), (2, f"x {shared} y {other}"), (3, f"{other} z"), (4, "short")]
    docs = lz_spans.with_rows(spark.createDataFrame(rows, "doc_id long, text string"))
    words = {r.row: r.text.split() for r in docs.collect()}
    found = lz_spans.factors(docs).collect()
    assert len(found) == 2 and all(f.n_words > 200 for f in found)
    assert all(words[f.row][f.begin : f.begin + f.n_words] == words[f.ref_row][f.ref_begin : f.ref_begin + f.n_words] for f in found)
    spans = {(r.row, r.begin, r.last) for r in lz_spans.repeated_windows(docs.select("row", "text"), lz_spans.WINDOW, lz_spans.ANCHOR).collect()}
    for f in found:  # every window of a factor is in a span
        assert any(r == f.row and a <= f.begin and f.begin + f.n_words - lz_spans.WINDOW <= b for r, a, b in spans)


def test_factors_go_beyond_their_anchors(spark):
    """Two documents share 50 words between others of their own: no block is the same, so only words by words is the passage found."""
    shared = " ".join(f"s{i}" for i in range(50))
    rows = [(1, " ".join(f"a{i}" for i in range(60)) + f" {shared} " + " ".join(f"b{i}" for i in range(60))), (2, " ".join(f"c{i}" for i in range(60)) + f" {shared} " + " ".join(f"d{i}" for i in range(60)))]
    docs = lz_spans.with_rows(spark.createDataFrame(rows, "doc_id long, text string")).select("row", "text")
    words = {r.row: r.text.split() for r in docs.collect()}

    def under(extend):
        found = lz_spans.repeated_windows(docs, lz_spans.WINDOW, lz_spans.ANCHOR, extend=extend).collect()
        return sorted({w for r in found for k in range(r.begin, r.last + lz_spans.WINDOW) for w in [words[r.row][k]]})

    assert under(True) == sorted(shared.split()) and under(False) != under(True)
    found = [f for f in lz_spans.factors(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert [f.n_words for f in found] == [50] and all(words[f.row][f.begin : f.begin + 50] == words[f.ref_row][f.ref_begin : f.ref_begin + 50] for f in found)


@pytest.mark.parametrize("share", [256, 3])
def test_spans_equal_brute_force(spark, monkeypatch, share):
    """Passages of 20 to 90 words in many documents, next to other words, some twice in one, in shares of a few blocks."""
    monkeypatch.setattr(lz_spans, "SHARE", share)
    rnd = random.Random(3)
    passages = [[f"p{k}x{i}" for i in range(rnd.randint(20, 90))] for k in range(8)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rnd.randint(0, 6)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            words += [f"d{d}y{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 30))] + p[a : a + rnd.randint(1, 90)]
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string")
    found = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in lz_spans.deduplicated(docs).collect())
    assert found == sorted((i, *x) for (i, _), x in zip(rows + rows[:2], kept_words(rows + rows[:2], lz_spans.WINDOW), strict=True))


def components(rows):
    sets = {}
    for i, t in rows:
        ws = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")]
        sets.setdefault(i, []).append({tuple(ws[j : j + 5]) for j in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark, texts):
    found = {r.doc_id: r.component_id for r in circulant_minhash.near_duplicates(table(spark, SF, "documents")).collect()}
    assert found == components(texts.items())


def test_near_duplicates_of_odd_rows(odd):
    rows = circulant_minhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == components([(i, t) for i, t in ODD if i is not None])
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)


def test_pairs_of_a_large_bucket_all_meet(spark, monkeypatch):
    """Classes of one bucket without another common band still meet; only the largest component's pairs are made apart."""
    monkeypatch.setattr(circulant_minhash, "LARGE", 2)
    sketch = ", ".join(f"{c} long" for c in circulant_minhash.SKETCH)
    rows = [(1, i, 100, 9, 0, max(1, i - 3), 1, *[0] * len(circulant_minhash.SKETCH)) for i in range(1, 11)]
    buckets = spark.createDataFrame(rows, f"key long, class long, n long, size long, band int, component long, most long, {sketch}")
    found = {(r["class"], r.group) for r in circulant_minhash.across(buckets).collect()}
    own = {r[1]: r[5] for r in rows}
    assert found >= {(a, own[b]) for a in own for b in own if 1 < own[a] < own[b]} | {(a, 1) for a in own if own[a] > 1}


def near_copies(n_groups):
    """Groups of near copies within one template of about two thirds of the words."""
    out = []
    for g in range(n_groups):
        body = [f"t{i}" for i in range(240)] + [f"g{g}x{i}" for i in range(50)]
        out += [(10 * g + v, " ".join([*body[:-v], *(f"v{g}y{v}z{i}" for i in range(v))] if v else body)) for v in range(3)]
    return out


def test_near_duplicates_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(circulant_minhash, "LARGE", 1)
    rows = near_copies(30)
    found = {r.doc_id: r.component_id for r in circulant_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == components(rows)


def test_token_files_round_trip(spark, texts):
    at, expected = 0, {}
    for i in sorted(texts):
        ids = ids_of(texts[i])
        expected[i] = (at, len(ids), crc(ids))
        at += len(ids)
    found = context_coder.read_files(context_coder.written_files(table(spark, SF, "documents"), BPE))
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in found.collect()} == expected


def test_token_files_detect_damage():
    block = np.arange(500) % 37 + 1000
    data = context_coder.encoded(block)
    assert (context_coder.decoded(data) == block).all() and len(data) < len(block)
    for at, bit in ((0, 1), (5, 1), (len(data) - 40, 255), (len(data) - 1, 128)):
        with pytest.raises(ValueError, match="checksum|format"):
            context_coder.decoded(data[:at] + bytes([data[at] ^ bit]) + data[at + 1 :])
    with pytest.raises(ValueError, match="format"):
        context_coder.decoded(data[:-2])


@pytest.mark.parametrize("n", [1, 2, 255, 511, 512, 5000, 70001])
def test_blocks_of_any_size_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 50257
    assert (context_coder.decoded(context_coder.encoded(ids)) == ids).all()
    same = np.full(n, 3)
    assert (context_coder.decoded(context_coder.encoded(same)) == same).all()


def test_token_files_are_smaller_than_deflated(spark):
    """Under what deflate and the ids' static frequencies need, on the texts of sf0.01."""
    texts = pa.array([r.text for r in table(spark, SF.replace("0.001", "0.01"), "documents").orderBy("doc_id").select("text").collect()], pa.string())
    ids, _ = TokenIds(BPE).encode(texts)
    share = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    bits = 8 * sum(len(context_coder.encoded(ids[i : i + context_coder.BLOCK])) for i in range(0, len(ids), context_coder.BLOCK)) / len(ids)
    assert bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids) - 1 and bits < -(share * np.log2(share)).sum()


def test_units_give_the_ids_of_whole_texts():
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\u00a0", "\u3000", "\u2009", "\x1c", "\x85", "a", "Bc", "it's", "'s", "'", "é", "ñandú", "你好", "…", "—", "12", "٣", "!", "...", "-", "_", "|", "<|endoftext|>", "😀", "e\u0301", "ſ", "\u200b", "\x00", "word", "\ufeff"]
    rng = random.Random(5)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(6000)] + [None, "", LONG]
    ids, at = TokenIds(BPE).encode(pa.array(texts, pa.string()))
    whole = Tokenizer.from_file(BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [[*w.ids, 2] for w in whole]


def test_units_are_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(token_ids, "UNITS_KEPT", 20)
    tokens, texts = TokenIds(BPE), [" ".join(f"word{i * k}" for i in range(40)) for k in range(5)]
    for t in texts * 2:
        assert tokens.encode(pa.array([t]))[0].tolist() == ids_of(t)


@pytest.mark.parametrize("source", ["driver", "odd"])
def test_packing(spark, texts, odd, source):
    docs, rows = (table(spark, SF, "documents"), list(texts.items())) if source == "driver" else (odd, ODD)
    found = slack_packing.packed(docs, BPE).collect()
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append((r.start, r.piece, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    expected = defaultdict(list)
    for i, t in rows:
        ids = ids_of(t)
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        expected[i] += [(a, k, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert {i: sorted(x) for i, x in by_doc.items()} == {i: sorted(x) for i, x in expected.items()}
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in found)
    assert len(bins) <= -(-total // 1024) * 1.02 + 2


def test_digests(spark, texts):
    order = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in quartile_digest.fingerprints(table(spark, SF, "documents")).collect()}
    for i, after in zip(order, [*order[1:], order[0]], strict=True):
        n = len(texts[i]) // 3
        edited = texts[i][: len(texts[i]) - n] + texts[after][:n]
        assert rows[i].n_chars == len(texts[i]) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[i].edited_fingerprint == quartile_digest.digest_text(quartile_digest.digest_codes(edited.encode()))
        codes = [quartile_digest.parsed(rows[x].fingerprint) for x in (i, after)]
        assert abs(rows[i].near_next - (1 - quartile_digest.difference(*codes))) < 1e-12 and 0 <= rows[i].near_edited <= 1


def plain_digest(data):
    """The digest in plain Python: buckets by a multiplied hash, codes by quartiles of the counts, length on a log scale."""
    counts = [0] * 256
    for i in range(len(data) - 2):
        counts[(data[i] + 256 * data[i + 1] + 65536 * data[i + 2]) * 2654435761 % 2**32 >> 24] += 1
    q = [sorted(counts)[k] for k in (63, 127, 191)]
    codes = [sum(c > x for x in q) for c in counts] if len(data) > 2 else [0] * 256
    return codes, min(255, int(math.log(1 + len(data)) * 10))


def plain_likeness(a, b):
    most = sum(map(max, a[0], b[0]))
    steps = sum(abs(x - y) for x, y in zip(a[0], b[0], strict=True)) / most if most else 0
    return 1 - 0.9 * steps - 0.1 * min(1, abs(a[1] - b[1]) / 24)


def test_digests_equal_plain_python(spark, texts):
    order = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in quartile_digest.fingerprints(table(spark, SF, "documents")).collect()}
    for i, after in list(zip(order, [*order[1:], order[0]], strict=True))[::5]:
        n = len(texts[i]) // 3
        own, changed, nxt = (plain_digest(t.encode()) for t in (texts[i], texts[i][: len(texts[i]) - n] + texts[after][:n], texts[after]))
        packed = [sum(c << s for c, s in zip(own[0][k : k + 4], (6, 4, 2, 0), strict=True)) for k in range(0, 256, 4)]
        assert rows[i].fingerprint == f"{own[1]:02x}" + bytes(packed).hex()
        assert rows[i].near_edited == pytest.approx(plain_likeness(own, changed)) and rows[i].near_next == pytest.approx(plain_likeness(own, nxt))


def test_token_files_of_odd_rows(odd, monkeypatch):
    """Null, empty and repeated rows, null ids, clashing columns, and documents over several blocks."""
    found = sorted(((r.doc_id is None, r.doc_id or 0, r.start), r.n_tokens, r.ids_crc32) for r in context_coder.read_files(context_coder.written_files(odd, BPE)).collect())
    expected = sorted((i is None, i or 0, len(ids_of(t)), crc(ids_of(t))) for i, t in ODD)
    assert sorted((a[0], a[1], n, c) for a, n, c in found) == expected
    spans = sorted((a[2], n) for a, n, _ in found)
    assert all(x + n == y for (x, n), (y, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    assert context_coder.read_files(context_coder.written_files(odd.limit(0), BPE)).count() == 0


@pytest.mark.parametrize("sizes", [(5,), (3, 4, 0, 9), (1, 1, 1), (1 << 16, 77)])
def test_checksums_of_pieces_are_joined(sizes):
    rnd = random.Random(len(sizes))
    parts = [bytes(rnd.randrange(256) for _ in range(n)) for n in sizes]
    assert context_coder.joined_crc([(len(p), zlib.crc32(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_digests_of_odd_rows(odd):
    rows = quartile_digest.fingerprints(odd).collect()
    assert len(rows) == len(ODD) and len({r.fingerprint for r in rows if r.doc_id in (6, 7)}) == 1


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_matches_equal_brute_force(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank at noon today"
    near = item.replace("quick", "quikc").replace("lazy", "lay")
    far = item.replace("brown fox", "green hen").replace("river", "house")
    rows = [(1, f"start {item.upper()} end"), (2, f"x {near} y"), (3, f"x {far} y"), (4, None), (5, ""), (6, item[: len(item) // 2]), (7, "  ".join(item.split()))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.n_errors for r in edit_matching.contaminated(docs, items).collect()}
    expected = {}
    for i, t in rows:
        for k, x in ((1, item), (4, "short")):
            d = edits(x, edit_matching.normal(t)) if t else 99
            if d <= int(len(x) * edit_matching.ERRORS):
                expected[i, k] = d
    assert found == expected
    assert edit_matching.contaminated(docs, items.where("item_id > 9")).count() == 0
    assert edit_matching.decontaminated(docs, items).count() == len(rows) - len({i for i, _ in found})


def auc(rows):
    """How often a row with label 1 has the higher score than one with label 0."""
    ones, zeros = ([s for s, y in rows if y == k] for k in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.mark.parametrize(("op", "target", "least", "positive"), [(queries.op5_toxic_lexicon, "toxic", 0.93, 0.6), (queries.op6_quality_rules, "quality", 0.97, 0.9)])
def test_held_out_scores(spark, op, target, least, positive):
    """A constant score has an AUC of 0.5, and one that never says 1 finds none."""
    sf = SF.replace("0.001", "0.1")
    rows = op(spark, sf).where("held_out").join(table(spark, sf, "labels").where(F.col(target).isNotNull()), "doc_id").collect()
    assert len(rows) > 500 and auc([(r.score, r[target]) for r in rows]) >= least
    found = [r.predicted for r in rows if r[target] == 1]
    wrong = [r.predicted for r in rows if r[target] == 0]
    assert sum(found) / len(found) >= positive and sum(wrong) / len(wrong) <= 0.1


def test_classifiers_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one_class = spark.createDataFrame([(4, 1, 1)], "doc_id long, quality int, toxic int")
    for module in (quality_rules, toxic_lexicon):
        assert {r.score for r in module.scored(odd, none).collect()} == {0.5}
        assert all(r.score > 0.5 for r in module.scored(odd, one_class).collect())


def test_page_texts(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a> <a href=/x>News</a></nav>
    <article><h1>A title</h1><p>First   paragraph of the article &amp; more words in it.</p><p>Second one,<br>with <b>bold</b> words.</p></article>
    <div class="comments"><p>A reader says something long enough to be a paragraph of text.</p></div><footer>Copyright</footer></body></html>"""
    pages = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (1, "u", page)], "page_id long, url string, html string")
    rows = html_text.page_texts(pages).collect()
    assert [r.text for r in rows if r.page_id == 1] == ["A title\n\nFirst paragraph of the article & more words in it.\n\nSecond one, with bold words."] * 2
    assert all(r.text == "" and r.n_chars == 0 for r in rows if r.page_id != 1)


def test_links_in_main_text_and_text_outside(spark):
    tree = html_text.content_tree(spark)
    used = {html_text.FEATURES[f] for p in paths(tree) for f, _, _ in p}
    assert used >= {"words", "links", "main", "boilerplate"} and used & {"words_before", "links_before"} and used & {"words_after", "links_after"}
    prose = lambda n: " ".join(f"prose{i}" for i in range(n))
    links = "".join(f"<li><a href='/{i}'>Topic {i}</a></li>" for i in range(12))
    page = f"<body><article><h1>Head</h1><p>{prose(40)}</p><ul>{links}</ul><p>{prose(50)} <a href=x>one link</a></p></article></body>"
    assert html_text.main_text(page, tree) == f"Head\n\n{prose(40)}\n\n{prose(50)} one link"
    long = "".join(f"<div><p>{prose(n)}</p></div>" for n in (120, 150, 130))
    assert html_text.main_text(f"<body>{long}<article><p>{prose(90)}</p></article></body>", tree).count("\n\n") >= 2
    comments = f"<section class='comments'><article><p>{prose(120)}</p></article><p>{prose(150)}</p></section>"
    assert html_text.main_text(f"<article class='post share'><p>{prose(60)}</p></article>{comments}", tree) == prose(60)
    assert html_text.main_text(f"<form><div class=legal><main><p>{prose(60)}</p></main></div></form>", tree) == prose(60)


@pytest.mark.parametrize("size", [10, 5_000, 500_000])
def test_quoted_values_of_any_length(spark, size):
    """A tag ends behind its quoted values, however long they are and whatever tags they hold."""
    tree, prose = html_text.content_tree(spark), " ".join(f"word{i}" for i in range(40))
    inside = "x" * size + "<p>LEAK in quotes</p>' and > and <b>"
    page = f"<article><p>{prose}</p><img alt = \"{inside}\" data-x='{inside.replace(chr(39), '')}'><p title=it's>{prose} it's</p></article>"
    assert html_text.main_text(page, tree) == f"{prose}\n\n{prose} it's"


@pytest.mark.parametrize("piece", ["<div>", "<![CDATA[", "<a b='c' ", "<a 'b\" ", "<script>", "</x", "<p title=\"", "<", "<!--", "<div>x</p>", "&amp"])
def test_broken_pages_take_linear_time(piece):
    page = piece * ((1 << 20) // len(piece))
    began = time.process_time()
    html_text.blocks_of(page)
    assert time.process_time() - began < 6


class PlainParser(HTMLParser):
    """The blocks' texts of pages without broken markup, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.quiet = [], "", 0

    def handle_starttag(self, tag, attrs):
        if tag in html_text.RAW:
            self.quiet += 1
        self.breaks(tag)

    def handle_endtag(self, tag):
        if tag in html_text.RAW:
            self.quiet = max(0, self.quiet - 1)
        self.breaks(tag)

    def breaks(self, tag):
        if tag == "br" or tag in html_text.RAW:
            self.text += " "
        elif tag not in html_text.INLINE:
            self.close_block()

    def handle_data(self, data):
        if not self.quiet:
            self.text += data

    def close_block(self):
        if self.text.split():
            self.blocks.append(" ".join(self.text.split()))
        self.text = ""


def test_blocks_equal_a_plain_parser(spark):
    for r in table(spark, SF, "pages").collect():
        plain = PlainParser()
        plain.feed(r.html or "")
        plain.close()
        plain.close_block()
        assert [b[0] for b in html_text.blocks_of(r.html or "")] == plain.blocks


def test_urls(spark):
    urls = ["http://A.Example.NET/en/x?q", "https://example.com/de/a#b", "http://x.org/fr/", "http://net/", None, "no scheme", "ftp://notnet/", "http://example.net/de"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judged_pages(pages, labels).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[1][2:] == ("example.com/de/", "block") and got[2][2:] == ("org/fr/", "allow")
    assert got[3][2] == "net/" and got[4][:2] == ("", "") == got[5][:2] and got[6][2] is None and got[7][2:] == ("net/", "block")


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    for df in (lz_spans.deduplicated(docs), circulant_minhash.near_duplicates(docs), quartile_digest.fingerprints(docs), slack_packing.packed(docs, BPE), context_coder.read_files(context_coder.written_files(docs, BPE))):
        assert df.count() == 0


def test_reputation_follows_labels(spark):
    """Bad hosts are blocked, their domain's unknown hosts as well, a good one next to them is not; repeated rows, empty tables and other columns do no harm."""
    hosts = ["bad.evil.example.info"] * 30 + ["worse.evil.example.info"] * 30 + ["fine.good.example.dev"] * 60 + ["new.example.info", "new.example.dev", "A.B"]
    pages = spark.createDataFrame([(i, f"https://{h}/x", "u", 0.5) for i, h in enumerate(hosts)] + [(0, "https://bad.evil.example.info/x", "u", 0.5)], "page_id long, url string, host string, bad_rate double")
    labels = spark.createDataFrame([(i, int("info" in h), "z") for i, h in enumerate(hosts[:120])] + [(None, 1, "z"), (5, None, "z")], "page_id long, bad int, verdict string")
    rows = url_reputation.judged_pages(pages, labels).collect()
    assert len(rows) == len(hosts) + 1
    verdict = {r.host: r.verdict for r in rows}
    assert verdict["bad.evil.example.info"] == verdict["worse.evil.example.info"] == verdict["new.example.info"] == "block" and verdict["fine.good.example.dev"] == verdict["new.example.dev"] == "allow"
    assert url_reputation.judged_pages(pages.limit(0), labels).count() == 0 and url_reputation.judged_pages(pages, labels.limit(0)).where("verdict = 'block'").count() == 0


@pytest.mark.parametrize("module", [toxic_lexicon, quality_rules])
def test_classifiers_with_odd_rows(spark, module):
    """Every row gets a score, equal texts the same one; empty tables have none."""
    sf = SF.replace("0.001", "0.01")
    labels = table(spark, sf, "labels")
    known = table(spark, sf, "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(900001, None), (900001, None), (900002, ""), (900003, LONG), (900004, LONG), (None, "null id")], "doc_id long, text string")
    docs = known.union(extra).withColumns({"score": F.lit(9.0), "label": F.lit("x"), "measures": F.lit(1)})
    rows = module.scored(docs, labels).where("doc_id IS NULL OR doc_id > 900000").collect()
    by_id = {r.doc_id: r.score for r in rows}
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows) and by_id[900003] == by_id[900004] and by_id[900001] == by_id[900002]
    assert module.scored(docs.limit(0), labels).count() == 0


def test_matching_with_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog near the river bank at noon today"
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, item, 5), (3, item, 5), (4, LONG + item + LONG, 5), (None, item, 5)], "doc_id long, text string, n_errors int")
    items = spark.createDataFrame([(1, item, 1), (1, item, 1), (2, None, 1)], "item_id long, text string, end int")
    found = edit_matching.contaminated(docs, items).collect()
    assert sorted((str(r.doc_id), r.n_errors) for r in found) == [("3", 0)] * 4 + [("4", 0)] * 2 + [("None", 0)] * 2
    assert sorted(r.doc_id for r in edit_matching.decontaminated(docs, items).collect()) == [1, 2] and edit_matching.decontaminated(docs, items.limit(0)).count() == 6
    assert edit_matching.contaminated(docs.limit(0), items).count() == 0


def test_pages_with_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x" * 50000, 1), (2, None, "&lt;no tags&gt;  at all", 2), (2, None, None, 3), (None, "v", "<p>one<p>two", 4)], "page_id long, url string, html string, text long")
    rows = {(r.page_id, r.n_chars) for r in html_text.page_texts(pages).collect()}
    assert len(rows) == 4 and (2, 0) in rows and html_text.page_texts(pages.limit(0)).count() == 0
