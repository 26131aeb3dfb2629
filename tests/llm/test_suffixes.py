import random

import numpy as np
import pytest

from packetmill.llm import suffixes


def brute(texts, span):
    """Removed byte runs of each text, texts in order."""
    seen, out = set(), []
    for raw in texts:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - span + 1):
            w = raw[i:i + span]
            if w in seen:
                gone[i:i + span] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        out.append([(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])])
    return out


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_suffix_array(tmp_path, block):
    rng = random.Random(1)
    for _ in range(25):
        segments = [bytes(rng.choice(b"ab\xc3") for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 30))]
        segments += segments[:3]
        owner, size, lcp = suffixes.suffix_array(segments, str(tmp_path), block)
        want = sorted((seg[len(seg) - k:], s) for s, seg in enumerate(segments) for k in range(len(seg) + 1))
        got = [(segments[o][len(segments[o]) - z:], int(o)) for o, z in zip(owner, size)]
        assert got == want
        for i in range(1, len(got)):
            a, b = got[i - 1][0], got[i][0]
            n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[i] == n
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize("n", [1, 15, 16, 17, 33, 500])
def test_range_minima(n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 255, n).astype(np.uint8)
    begin = rng.integers(0, n, 400)
    end = begin + 1 + (rng.random(400) * (n - begin)).astype(np.int64)
    got = suffixes.RangeMin(values)(begin, end)
    assert got.tolist() == [values[a:b].min() for a, b in zip(begin, end)]


def corpus(rng, n):
    word = lambda: "".join(rng.choice(["the", "of", "ing", "é", "日", "x"]) for _ in range(rng.randrange(1, 4)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(4)]
    out = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(40)))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passage)
            a = rng.randrange(len(p) // 2)
            parts.append(p[a:a + rng.randrange(30, len(p))] if rng.random() < 0.6 else p)
            parts.append(" ".join(word() for _ in range(rng.randrange(6))))
        if i % 9 == 0:
            parts.append((word() + " ") * rng.randrange(120))
        t = " ".join(parts)
        out.append(t)
        if rng.random() < 0.3:
            k = rng.randrange(len(t) + 1)
            out.append(t[:k] + word() + t[k + 2:] if rng.random() < 0.6 else t)
    return out


def check(frame, rows, span=100, **how):
    got = suffixes.remove_repeats(frame(rows), span=span, **how).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    raws = [(t or "").encode() for _, t in order]
    want = []
    for (i, _), raw, gone in zip(order, raws, brute(raws, span)):
        kept = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(raw)]))
        want.append((str(i), len(raw), gone, kept))
    assert sorted(want) == sorted((str(r.doc_id), r.n_bytes, list(zip(r.starts, r.ends)), bytes(r.kept)) for r in got)


def test_against_all_windows(frame):
    texts = corpus(random.Random(3), 120)
    rows = [(i, t) for i, t in zip(random.Random(2).sample(range(1000), len(texts)), texts)]
    check(frame, rows)
    check(frame, rows, bucket_bytes=5000, bucket_segments=20)


def test_cut_texts(frame, monkeypatch):
    monkeypatch.setattr(suffixes, "_AT_ONCE", 150)
    raws = [t.encode() for t in corpus(random.Random(5), 10)]
    runs = np.concatenate(list(suffixes.text_runs(list(range(len(raws))), raws, 100, 50)))
    for k, raw in enumerate(raws):
        at = sorted(p for r in runs[runs["key"] == k] for p in range(r["a"], r["a"] + r["w"]))
        assert at == list(range(len(raw) - 99))


def test_odd_rows(frame, odd):
    rows = [(i, t if t is None else t[:4000]) for i, t in odd] + [(30, "y" * 99), (31, "y" * 100), (32, "y" * 101), (33, "word " * 700)]
    check(frame, rows)
    assert len(suffixes.remove_repeats(frame(odd)).collect()) == len(odd)
    assert suffixes.remove_repeats(frame(odd).limit(0)).count() == 0


def test_one_passage_in_many_surroundings(frame, spark, monkeypatch):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(130)
    rows = [(i, word(rng.randrange(90)) + passage + word(rng.randrange(90))) for i in range(90)]
    sizes, written = [], suffixes.materialise

    def kept(df, name):
        out = written(df, name)
        if name == "repeat-asked":
            sizes.extend(out.filter("bucket >= 0").groupBy("bucket", "m").count().collect())
            sizes.append(out.filter("bucket < 0").count())
        return out

    monkeypatch.setattr(suffixes, "materialise", kept)
    check(frame, rows, bucket_segments=20)
    assert sizes and sizes.pop() > 60 and all(r["count"] <= 20 for r in sizes)
