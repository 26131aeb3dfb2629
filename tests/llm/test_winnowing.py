import hashlib
import random

import numpy as np

from packetmill.llm import winnowing


def brute(text, gram, window):
    codes = np.array([ord(c) for c in text], np.uint32)
    if not len(codes):
        return []
    gram = min(gram, len(codes))
    h = [int(winnowing.gram_hashes(codes[i:i + gram], gram)[0]) for i in range(len(codes) - gram + 1)]
    window = min(window, len(h))
    out = []
    for i in range(len(h) - window + 1):
        at = max(range(i, i + window), key=lambda j: (-h[j], j))
        if (h[at], at) not in out[-1:]:
            out.append((h[at], at))
    return out


def test_selection_is_the_rightmost_minimum(monkeypatch):
    rng = random.Random(2)
    for at_once in (7, 1 << 20):
        monkeypatch.setattr(winnowing, "_AT_ONCE", at_once)
        for text in ["", "a", "abc" * 3, "ab" * 200, "x" * 300, "".join(rng.choice("abé日") for _ in range(400))]:
            for gram, window in ((5, 4), (24, 77), (8, 1)):
                hashes, places = winnowing.winnow(text, gram, window)
                assert list(zip(hashes.tolist(), places.tolist())) == brute(text, gram, window)


def test_match_guarantee():
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(30):
        shared = word(winnowing.GRAM + winnowing.WINDOW - 1)
        a, b = (winnowing.winnow(word(rng.randrange(300)) + shared + word(rng.randrange(300)))[0] for _ in range(2))
        assert len(np.intersect1d(a, b))


def test_text_form_round_trip():
    hashes, places = winnowing.winnow("some words in a row " * 30 + "and an end")
    back = winnowing.from_text(winnowing.to_text(hashes, places))
    assert (back[0] == hashes).all() and (back[1] == places).all()


def check(frame, rows, part_bytes):
    got = winnowing.compare_with_next(frame(rows), part_bytes=part_bytes).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""), reverse=True)
    want = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        new = text[:len(text) - n] + after[:n]
        a, b, c = (winnowing.winnow(t) for t in (text, new, after))
        want.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), winnowing.to_text(*a), winnowing.to_text(*b),
                     winnowing.likeness(a[0], b[0]), winnowing.likeness(a[0], c[0])))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_against_one_pass(frame, odd):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("abc de") for _ in range(rng.randrange(600)))) for i in rng.sample(range(10_000), 60)]
    check(frame, rows, 3000)
    check(frame, rows, 1 << 20)
    check(frame, odd, 50_000)
    check(frame, [(5, "alone " * 50)], 100)
    assert winnowing.compare_with_next(frame(rows).limit(0)).count() == 0


def test_likeness_of_short_texts():
    rng = random.Random(9)
    off = []
    for _ in range(400):
        text, after = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (rng.randrange(34, 100), 100))
        new = winnowing.edited(text, after)
        a, b = winnowing.winnow(text)[0], winnowing.winnow(new)[0]
        grams = [{t[i:i + winnowing.GRAM] for i in range(len(t) - winnowing.GRAM + 1)} for t in (text, new)]
        assert 0 < winnowing.likeness(a, b)
        off.append(winnowing.likeness(a, b) - len(grams[0] & grams[1]) / len(grams[0] | grams[1]))
    assert abs(np.mean(off)) < 0.05 and np.mean(np.abs(off)) < 0.15
