import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers

from packetmill.llm import langid, lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return lattice.Vocabulary(f.read())


def cuttings(vocabulary, logp, word):
    """Sum over all ways to cut, one by one."""
    pieces = {h: k for h, k in zip(vocabulary.hashes.tolist(), vocabulary.places.tolist())}
    b = "▁".encode() + word

    def rest(at):
        if at == len(b):
            return [[]]
        out = [[vocabulary.fallback[b[at]]] + r for r in rest(at + 1)]
        for end in range(at + 1, len(b) + 1):
            k = pieces.get(lattice._hash(b[at:end]))
            if k is not None:
                out += [[k] + r for r in rest(end)]
        return out

    return rest(0)


def test_marginal_and_expected_counts(vocabulary):
    logp = lattice.normalise(vocabulary.start, 0.0)
    assert abs(np.exp(logp).sum() - 1) < 1e-9
    words = [b"the", b"a", "né".encode(), b"tion", b"xq", b"", b"there"]
    counts = np.array([3.0, 1, 2, 1, 5, 1, 1])
    got, uses = lattice.word_scores(vocabulary, logp, words), lattice.expected_counts(vocabulary, logp, words, counts)
    want_uses = np.zeros(vocabulary.size)
    for w, c, g in zip(words, counts, got):
        ways = cuttings(vocabulary, logp, w)
        probability = [math.exp(sum(logp[k] for k in way)) for way in ways]
        assert abs(g - math.log(sum(probability))) < 1e-9
        for way, p in zip(ways, probability):
            for k in way:
                want_uses[k] += c * p / sum(probability)
    assert np.allclose(uses, want_uses)


def test_long_words(vocabulary):
    logp = lattice.normalise(vocabulary.start, 0.0)
    got = lattice.word_scores(vocabulary, logp, [b"long" * 5000, b"a"])
    assert np.isfinite(got).all() and got[0] < -10_000


def test_base_counts_and_better_than_start(spark, frame, odd):
    rng = random.Random(6)
    parts = "the and of ing er tion ly th re on".split()
    rows = odd + [(50 + i, " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 3))) for _ in range(60))) for i in range(80)]
    held = langid.in_fold("doc_id", 5, 1)
    got = {(r.doc_id, r.n_tokens, round(r.base_score, 6)): r for r in
           lattice.score(frame(rows), held, PATH, block_bytes=30_000).collect()}
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = Counter()
    for i, t in rows:
        if not out(i):
            train.update(lattice.words_of(t or ""))
            train["end"] += 0
    ends = sum(not out(i) for i, _ in rows)
    del train["end"]
    total, kinds = sum(train.values()) + ends, len(train) + 1
    p = lambda c: math.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    keys = set()
    for i, t in rows:
        words = lattice.words_of(t or "")
        base = sum(p(train[w]) for w in words) + p(ends)
        key = (i, len(words) + 1, round(base, 6))
        r = got[key]
        assert r.held_out == out(i) and r.train_tokens == total
        assert r.n_known == sum(train[w] > 0 for w in words) + 1 and r.score < 0 and math.isfinite(r.score)
        keys.add(key)
    assert keys == set(got)
    plain = lattice.score(frame(rows), held, PATH, rounds=0)
    a, b = (sum(r.score for r in x if r.held_out and (r.doc_id or 0) >= 50) for x in (got.values(), plain.collect()))
    assert a > b
    assert lattice.score(frame(rows).limit(0), held, PATH).count() == 0


def test_arcs_held_or_looked_up_anew_give_the_same(vocabulary, monkeypatch):
    logp, words = lattice.normalise(vocabulary.start, -3.0), [b"the", b"naming", b"straight" * 4, bytes(range(128, 160))]
    held = lattice.word_scores(vocabulary, logp, words), lattice.expected_counts(vocabulary, logp, words, np.arange(1.0, 5.0))
    monkeypatch.setattr(lattice, "_HELD", 0)
    anew = lattice.word_scores(vocabulary, logp, words), lattice.expected_counts(vocabulary, logp, words, np.arange(1.0, 5.0))
    assert all((a == b).all() for a, b in zip(held, anew))


def test_words_of_a_block_are_numbered_alike_in_any_order_of_rows():
    rows = [(2, "b a b", True), (1, None, False), (None, "c c", True), (2, "a d", True), (1, "e b", False)]
    found = []
    for at in (rows, rows[::-1]):
        table = lattice._in_order(lattice.pa.table({n: list(c) for n, c in zip(("id", "text", "train"), zip(*at))}))
        each, words = lattice._block_words(table)
        assert [[words[i] for i in ids] for ids in each] == [lattice.words_of(t or "") for t in table.column("text").to_pylist()]
        found.append(words)
    assert found[0] == found[1] and sorted(found[0]) == [b"a", b"b", b"c", b"d", b"e"]
