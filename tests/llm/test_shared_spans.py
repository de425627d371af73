"""p10: against every pair of texts, and the defined results."""

import random

import numpy as np

from ohmgrid.llm import shared_spans as ss


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in texts], "doc_id long, text string, key string, pos int")


def brute(texts):
    grams = [(i, {t[k : k + ss.LENGTH] for k in range(len(t) - ss.LENGTH + 1)}) for i, t in texts if t]
    return {(min(a, b), max(a, b)) for x, (a, g) in enumerate(grams) for b, h in grams[:x] if a != b and g & h}


def pairs(spark, texts):
    return {(r.doc_id_a, r.doc_id_b) for r in ss.SharedSpans(docs(spark, texts)).pairs().collect()}


def text(rng, n, alphabet="abcdefghij klmnop 0123456789\nÄ🙂µ"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_planted_spans_of_all_lengths(spark):
    rng = random.Random(1)
    out = []
    for k in range(120):
        n = 180 + k % 60
        span = text(rng, n, rng.choice(["ab", "a-", "abc \n", "abcdefghij klmnop 0123456789\nÄ🙂µ"]))
        a = text(rng, rng.randint(0, 300)) + span + text(rng, rng.randint(0, 300))
        b = text(rng, rng.randint(0, 300)) + span + text(rng, rng.randint(0, 300))
        out += [(2 * k, a), (2 * k + 1, b)]
    want = brute(out)
    assert len(want) > 60 and pairs(spark, out) == want


def test_runs_and_periods(spark):
    rng = random.Random(2)
    out = []
    for k, root in enumerate(["-", "ab", "abc", "=-", " ", "abcdefg", "x" * 9 + "y", "0123456789" * 3]):
        for j in range(4):
            n = rng.randint(150, 260)
            shift = rng.randint(0, len(root) - 1)
            out.append((10 * k + j, text(rng, 120) + (root * 400)[shift : shift + n] + text(rng, 120)))
    assert pairs(spark, out) == brute(out)


def test_copies_null_short_and_repeated(spark):
    rng = random.Random(3)
    t, u = text(rng, 400), text(rng, 400)
    texts = [(1, t), (2, t), (3, "x" + t[50:300]), (4, None), (5, ""), (6, t[:199]), (7, u), (7, u), (8, t[:200]), (9, t)]
    assert pairs(spark, texts) == brute(texts)
    assert pairs(spark, []) == set()
    assert pairs(spark, [(1, None)]) == set()


def test_large_groups_are_stars_with_their_members(spark, monkeypatch):
    monkeypatch.setattr(ss, "PAIRS_UPTO", 3)
    rng = random.Random(4)
    t, passage = text(rng, 300), text(rng, 220)
    texts = [(k, t) for k in range(1, 7)] + [(10, "y" + t)] + [(k, text(rng, 90) + passage) for k in range(20, 25)]
    got = ss.SharedSpans(docs(spark, texts))
    star = {(1, k) for k in range(2, 7)} | {(1, 10)} | {(20, k) for k in range(21, 25)}
    assert {(r.doc_id_a, r.doc_id_b) for r in got.pairs().collect()} == star
    assert {(r.doc_id, r.class_id, r.copies) for r in got.classes().collect()} == {(k, 1, 6) for k in range(1, 7)} | {(k, k, 1) for k in (10, *range(20, 25))}
    sets = {}
    for r in got.members().collect():
        sets.setdefault((r.set_id, r.first, r.n), set()).add(r.doc_id)
    assert {1, 10} in sets.values() and {20, 21, 22, 23, 24} in sets.values()
    assert all(first == min(own) and n == len(own) for (_, first, n), own in sets.items())


def test_many_documents_with_one_stretch(spark):
    rng = random.Random(5)
    shared = text(rng, 260)
    texts = [(k, text(rng, 150) + shared + text(rng, 150)) for k in range(40)]
    assert len(pairs(spark, texts)) == 40 * 39 // 2


def test_spans_and_portions(spark):
    rng = random.Random(6)
    shared, other = text(rng, 250), text(rng, 210)
    texts = [(1, "#" * 10 + shared + text(rng, 300) + other), (2, other + "!" + shared), (3, text(rng, 500))]
    got = ss.SharedSpans(docs(spark, texts))
    spans = {(r.doc_id, r.start, r.length) for r in got.spans().collect()}
    assert spans == {(1, 10, 250), (1, 560, 210), (2, 0, 210), (2, 211, 250)}
    assert {r.doc_id: r.shared_chars for r in got.portions().collect()} == {1: 460, 2: 460, 3: 0}


def brute_spans(texts):
    where = {}
    for i, t in texts:
        for k in range(len(t) - ss.LENGTH + 1):
            where.setdefault(t[k : k + ss.LENGTH], set()).add(i)
    out = set()
    for i, t in texts:
        hit = [k for k in range(len(t) - ss.LENGTH + 1) if len(where[t[k : k + ss.LENGTH]]) > 1]
        begins = [k for j, k in enumerate(hit) if not j or k - hit[j - 1] > ss.LENGTH]
        for k, after in zip(begins, [*begins[1:], len(t)]):
            out.add((i, k, max(x for x in hit if x < after) + ss.LENGTH - k))
    return out


def test_spans_of_repeated_passages_and_runs(spark):
    rng = random.Random(9)
    passage, line = text(rng, 240), text(rng, 70) + "\n"
    texts = [
        (1, passage + text(rng, 330) + passage + text(rng, 50)), (2, text(rng, 60) + passage),
        (3, text(rng, 40) + "-" * 500 + text(rng, 300)), (4, text(rng, 90) + "-" * 500),
        (5, line * 12 + text(rng, 400) + line * 6), (6, text(rng, 130) + line * 9), (7, passage[:150] * 4),
    ]
    want = brute_spans(texts)
    assert {(1, 0, 240), (1, 570, 240), (3, 40, 500), (4, 90, 500)} <= want
    got = ss.SharedSpans(docs(spark, texts))
    assert {(r.doc_id, r.start, r.length) for r in got.spans().collect()} == want
    portions = {r.doc_id: r.shared_chars for r in got.portions().collect()}
    assert portions == {i: sum(n for d, _, n in want if d == i) for i, _ in texts}


def test_boundaries_inside_a_shared_span_agree():
    rng = np.random.default_rng(7)
    for size in (2, 3, 30):
        span = rng.integers(97, 97 + size, 400).astype(np.uint32)
        found = []
        for _ in range(2):
            a = rng.integers(97, 97 + size, rng.integers(50, 90)).astype(np.uint32)
            cp = np.concatenate([a, span, rng.integers(97, 97 + size, 60).astype(np.uint32)])
            first = np.zeros(len(cp) + 1, bool)
            first[0] = True
            at, _ = ss.boundaries(cp, first)
            own = at - len(a)
            found.append(own[(own >= ss.CONTEXT) & (own < 400 - ss.CONTEXT)].tolist())
        assert found[0] == found[1]


def test_what_lies_outside_a_span_hides_no_key(monkeypatch):
    rng = np.random.default_rng(10)
    n, size, low = 50_000, 400, 100 + ss.CONTEXT  # the spans begin at 100
    at = np.cumsum(np.concatenate([np.zeros((n, 1), int), rng.integers(1, 2 * ss.ROUNDS[-1] + 1, (n, size))], 1), 1)
    there = at < size
    own = (np.append(at[:, 1:], at[:, -1:] + 1, 1) >= low) & (at <= low + ss.WINDOW)  # symbols beside a boundary of the span
    names = rng.integers(0, 1 << 32, (2, *at.shape), np.uint32)
    names[1][own] = names[0][own]
    starts, found = np.arange(n) * size, []
    for name in names:
        monkeypatch.setattr(ss, "boundaries", lambda cp, first, name=name: ((at + starts[:, None])[there], name[there]))
        kept, *_ = ss.anchors(np.zeros(n * size, np.uint32), starts, np.full(n, size))
        inside = (kept % size >= low) & (kept % size <= low + ss.WINDOW)
        found.append(kept[inside])
    assert len(np.unique(np.intersect1d(*found) // size)) == n


def test_very_long_text(spark, monkeypatch):
    rng = random.Random(8)
    big = text(rng, 30_000)
    assert pairs(spark, [(1, big), (2, text(rng, 100) + big[15_000:15_230]), (3, text(rng, 20_000))]) == {(1, 2)}
