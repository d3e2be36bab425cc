"""Hard negatives, phrases and personal data against brute force, and their defined cases."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from fairline.llm import anchor_expansion, bit_slices, queries, suffix_phrases
from fairline.llm.store import table
from tests.conftest import SF

VECTORS = "vec_id long, embedding array<float>, label int, key string, row int, v int, rank int"


def mined(rows, positives=5, negatives=5, least=80):
    """Every pair, in Python's integers."""
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, v, label) in enumerate(good):
        if i % 100:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for m, (j, w, other) in enumerate(good) if m != k and len(w) == len(v)]
        for p, positive, _ in sorted(s for s in scores if s[2] == label)[:positives]:
            fits = sorted((s, j) for s, j, other in scores if other != label and -80 * p <= -100 * s <= -100 * p)[:negatives]
            out += [(i, positive, rank, j, -p, -s) for rank, (s, j) in enumerate(fits, 1)]
    return sorted(out)


def found_negatives(spark, rows):
    df = spark.createDataFrame([(i, v, label, "k", 1, 2, 3) for i, v, label in rows], VECTORS)
    return sorted(map(tuple, bit_slices.hard_negatives(df, "key % 100 = 0").collect()))


@pytest.mark.parametrize("scale", [0.3, 3.0, 40.0])
def test_hard_negatives_equal_brute_force(spark, scale):
    rnd = np.random.default_rng(int(scale * 10))
    centres = rnd.normal(size=(3, 9)) * scale
    rows = [(i, [float(x) for x in (centres[i % 3] + rnd.normal(size=9) * scale / 3).astype(np.float32)], int(rnd.integers(0, 3))) for i in range(0, 900, 3)]
    expected = mined(rows)
    assert expected and found_negatives(spark, rows) == expected


def test_hard_negatives_of_odd_rows(spark):
    """Nulls, broken components, ties, repeated rows and ids, other lengths, zero and negative scores."""
    one, two = [1.0, 0.5, -0.25], [1.0, 0.25, 0.5]
    rows = [(0, one, 1), (1, one, 1), (1, one, 1), (2, one, 2), (2, one, 2), (3, two, 2), (5, None, 1), (6, one, None), (None, one, 1), (7, [1.0, None, 1.0], 2), (8, [1.0, float("nan"), 0.0], 2), (9, [float("inf"), 0.0, 0.0], 2)]
    rows += [(100, [0.0, 0.0, 0.0], 1), (200, [-x for x in one], 1), (300, [1.0], 1), (301, [1.0], 1), (302, [0.9], 2), (400, [], 1), (401, [], 1), (402, [], 2), (200, [-x for x in one], 1)]
    assert found_negatives(spark, rows) == mined(rows)
    assert found_negatives(spark, []) == [] and found_negatives(spark, [(1, one, 1), (2, one, 2)]) == []


def test_blocks_of_anchors(spark, monkeypatch):
    monkeypatch.setattr(bit_slices, "PASS_BYTES", 100)
    rnd = random.Random(2)
    rows = [(20 * i, [rnd.uniform(-1, 1) for _ in range(6)], i % 2) for i in range(60)]
    assert found_negatives(spark, rows) == mined(rows)


def test_products_are_exact_and_drop_what_cannot_qualify():
    rnd = np.random.default_rng(4)
    for most in (1, 200, 1 << 20, 1 << 24):
        q, c = (rnd.integers(-most, most + 1, (n, 16)).astype(np.int32) for n in (20, 50))
        full = q.astype(object) @ c.astype(object).T
        cut, seen = int(np.sort(full.ravel())[-30]), []

        def wanted(low, high, i, j, cut=cut, seen=seen):
            seen.append(int((high >= cut).sum()))
            return high >= cut

        i, j, score = bit_slices.products(q, c, wanted)
        assert {(a, b): s for a, b, s in zip(i.tolist(), j.tolist(), score.tolist(), strict=True)} == {(a, b): full[a, b] for a in range(20) for b in range(50) if full[a, b] >= cut}
        assert seen == sorted(seen, reverse=True) and (most < 100 or seen[len(seen) // 2] < 1000)


def phrases(rows, max_n=3, least=10, covered=50, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            ws = [w for w in re.split(r"[ \t]+", piece) if w]
            total[lang or "und"] += len(ws)
            for k in range(1, max_n + 1):
                counts[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        inside = defaultdict(int)
        for p, a in cands.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        rows_ = []
        for p, a in cands.items():
            if p in inside and 100 * inside[p] >= covered * a:
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], 1)]
    return sorted(out)


def found_phrases(df, **options):
    return sorted(map(tuple, suffix_phrases.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_phrases_equal_brute_force(spark):
    docs = table(spark, SF, "documents")
    assert found_phrases(docs) == phrases([(r.lang, r.text) for r in docs.collect()])


@pytest.mark.parametrize(("hot", "max_n"), [(2000, 3), (8, 3), (5, 4), (30, 2)])
def test_hot_prefixes_are_counted_whole(spark, monkeypatch, hot, max_n):
    """Few words, so that many prefixes are hot and stand in several tasks, in small chunks; ties by the thousand."""
    monkeypatch.setattr(suffix_phrases, "HOT", hot)
    rnd = random.Random(hot)
    rows = [(rnd.choice(["en", "de", None]), " ".join(rnd.choice(["a", "b", "c", "d,", "Ab\0c", "\0", "é"]) for _ in range(rnd.randint(0, 40)))) for _ in range(300)]
    df = spark.createDataFrame([(x, t, 1, "s") for x, t in rows], "lang string, text string, n int, suffix string").repartition(7)
    assert found_phrases(df, max_n=max_n, top=50) == phrases(rows, max_n=max_n, top=50)


def test_phrases_of_odd_rows(spark):
    text = "Tick TOCK, tick tock. tick\ttock\n" * 3
    rows = [(None, text), ("en", None), ("en", ""), ("en", " \t .,;"), ("fr", text), ("fr", text), ("x\0y", text * 4), ("en", "one two three " * 3000)]
    df = spark.createDataFrame([(x, t, 5, "p") for x, t in rows], "lang string, text string, words int, phrase string")
    assert found_phrases(df) == phrases(rows)
    assert found_phrases(df.limit(0)) == [] and found_phrases(df.where("lang = 'en' AND text = ''")) == []


def test_scores_beyond_64_bits(spark):
    """A count whose square times a million passes 64 bits, with remainders that a double would round."""
    big = 10**13 + 7
    counts = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 1), ("en", 1, "c", 3 * 10**12), ("en", 2, "a c", 10**12 + 1)], "lang string, words int, phrase string, n long")
    found = {r.phrase: (r.l, r.r, r.score) for r in suffix_phrases.scored(counts, 50).collect()}
    assert found == {"a b": (big, big + 1, 10**6 * (big - 1) ** 2 // (big * (big + 1))), "a c": (big, 3 * 10**12, 10**6 * (10**12 + 1) ** 2 // (big * 3 * 10**12))}


def base_spans(text):
    out = []
    for kind, pattern in anchor_expansion.BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if not (kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn) or kind == "phone" and not 10 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], anchor_expansion.KINDS.index(s[0])))


def test_base_spans_equal_patterns():
    rnd = random.Random(1)
    parts = ["a", "b9", "@", ".", "-", "+", "1", "22", "255", "256", "999", " ", "4111111111111111", "4111 1111 1111 1111", "(", ")", "_", "é", "n@m.com", "1.2.3.4", "+1 (212) 555-7713", "::", "://", "0", "00", "\n", "％", "iban", "account: 12345678", "ssn 123-45-6789", "tel:", "[at]", "[dot]", "%"]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 25)))
        base, added = anchor_expansion.spans_of(text)
        assert base == base_spans(text) and not set(base) & set(added), text


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail jósé.pérez@exämple.com now", "email", "jósé.pérez@exämple.com"), ("x [at] host [dot] com", "email", "x [at] host [dot] com"), ("foo＠bar.com", "email", "foo＠bar.com"), ("call phone: (212) 555-7713 now", "phone", "(212) 555-7713"),
        ("IBAN: DE89 3704 0044 0532 0130 00.", "account", "DE89 3704 0044 0532 0130 00"), ("see https://bob:pw@host.com/x", "account", "bob"), ("at fe80::1ff:fe23:4567:890a end", "ip", "fe80::1ff:fe23:4567:890a"), ("account number: 1234567890", "account", "1234567890"),
        ("SSN: 123-45-6789", "person", "123-45-6789"), ("tel:212-555-7713", "phone", "212-555-7713"),
        ("IBAN: DE88 3704 0044 0532 0130 00.", None, None), ("std::vector<int>", None, None), ("accountant: 1234567890", None, None), ("SSN: 000-45-6789", None, None), ("a @ b.com and c@d", None, None), ("in 2019 at 10:30, 1,234.56 of 3.14", None, None),
    ],
)
def test_added_spans(text, kind, span):
    assert [(k, text[a:b]) for k, a, b in anchor_expansion.spans_of(text)[1]] == ([(kind, span)] if kind else [])


def test_personal_data(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = queries.QUERIES["op13_anchor_expansion"](spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        base = base_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in anchor_expansion.BASE]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(text.split(",")) <= set(r.spans.split(","))


def test_personal_data_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a@b.co"), (3, "a@b.co"), (None, "1.2.3.4"), (4, "x" * 3000 + "@" + "y" * 3000 + ".z"), (5, "0." * 2000), (6, "1 " * 2000 + "@@@@" + "+1" * 100), (7, "00000000000." * 5)]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, spans string, n_email int")
    found = sorted((str(r.doc_id), r.n_email, r.n_ip, r.spans) for r in anchor_expansion.personal_data(df).collect())
    expected = [(str(i), sum(s[0] == "email" for s in b), sum(s[0] == "ip" for s in b), ",".join(f"{k}:{x}:{y}" for k, x, y in b)) for i, t in rows for b in [base_spans(t or "")]]
    assert found == sorted(expected)
    assert anchor_expansion.personal_data(df.limit(0)).count() == 0


@pytest.mark.parametrize("piece", ["0.", "1 ", "a@", "é@", "account: ", "iban ", "::", "[at]", "://", "x://a@", "+1", "é", "a.b"])
def test_personal_data_takes_linear_time(piece):
    began = time.process_time()
    anchor_expansion.spans_of(piece * (200_000 // len(piece)))
    assert time.process_time() - began < 10
