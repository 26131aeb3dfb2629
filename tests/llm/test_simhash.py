import math
import random

import xxhash

from packetmill.llm import simhash


def brute(values, radius=3):
    seen = {}
    for a in values:
        seen[a] = a
    def root(x):
        while seen[x] != x:
            x = seen[x]
        return x
    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= radius:
                x, y = root(a), root(b)
                seen[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_fingerprint_counts_every_shingle():
    text = "The cat THE cat the cat sat"
    w = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One two") == xxhash.xxh64_intdigest("one two", 42)


def test_links_connect_like_all_pairs(spark):
    """Chains, rings around a centre and a crowd that shares half of the bits; also with the crowd limit at 2."""
    rng, values = random.Random(5), set()
    for _ in range(40):
        base = rng.getrandbits(64)
        values.add(base)
        for _ in range(12):
            base ^= sum(1 << rng.randrange(64) for _ in range(1)) ^ (1 << rng.randrange(64))
            values.add(base)
    centre = rng.getrandbits(64)
    for _ in range(150):
        v = centre
        for _ in range(rng.randrange(6)):
            v ^= 1 << rng.randrange(30)
        values.add(v)
        values.add(v ^ (1 << 40))
    values = sorted(signed(v) for v in values)
    unsigned = {v: v & ((1 << 64) - 1) for v in values}
    want = brute(list(unsigned.values()))
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    for crowd in (2, 64):
        edges = [(r.a, r.b) for r in simhash.links(fps, crowd=crowd).collect()]
        assert all(bin(unsigned[a] ^ unsigned[b]).count("1") <= 3 for a, b in edges)
        parent = {v: v for v in values}
        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for a, b in edges:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        got = {}
        for v in values:
            got.setdefault(root(v), set()).add(unsigned[v])
        groups = {}
        for v, r in want.items():
            groups.setdefault(r, set()).add(v)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_components(spark, frame, odd):
    rows = odd + [(20, "a b c d e f g h " * 40 + "tail one"), (21, "a b c d e f g h " * 40 + "tail two")]
    got = simhash.near_duplicates(frame(rows)).collect()
    assert len(got) == len(rows)
    fps = {simhash.fingerprint(t or "") for _, t in rows}
    root = brute(sorted(fps))
    least = {}
    for i, t in rows:
        r = root[simhash.fingerprint(t or "")]
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted((str(i), str(least.get(root[simhash.fingerprint(t or "")]))) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == want
    assert simhash.near_duplicates(frame(rows).limit(0)).count() == 0


def similar_pairs(texts, similarity=0.8):
    """All pairs of texts whose shingle sets are that similar, and their roots; knows nothing of sketches."""
    sets = []
    for text in texts:
        w = text.lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)})
    pairs = [(j, i) for i in range(len(texts)) for j in range(i)
             if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = sorted((top(i), top(j)))
        root[b] = a
    return pairs, [top(i) for i in range(len(texts))]


def changed(rng, text, n):
    w = text.split()
    for at in rng.sample(range(len(w)), n):
        w[at] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_links_of_absorbed_texts(frame, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 8, raising=False)
    monkeypatch.setattr(simhash, "MANY", 2, raising=False)
    monkeypatch.setattr(simhash, "DENSE", 2, raising=False)
    rng, texts = random.Random(11), []
    for _ in range(8):  # a frequent leader, a text like it, and one like the second only
        lead = " ".join(f"w{rng.randrange(10**6)}" for _ in range(300))
        member = changed(rng, lead, 4)
        texts += [lead, lead, lead, member, changed(rng, member, 4)]
    for _ in range(4):  # versions, each near the one before
        texts.append(" ".join(f"v{rng.randrange(10**6)}" for _ in range(300)))
        for _ in range(12):
            texts.append(changed(rng, texts[-1], 3))
    base = " ".join(f"b{rng.randrange(10**6)}" for _ in range(300))
    texts += [changed(rng, base, 5) for _ in range(120)]  # a drifting group without its middle
    rows = list(enumerate(texts))
    got = {r.doc_id: r.root for r in simhash.similar_groups(frame(rows), "doc_id").collect()}
    pairs, want = similar_pairs(texts)
    whole = {}
    for i in range(len(texts)):  # nothing is joined that all pairs do not join
        assert whole.setdefault(got[i], want[i]) == want[i]
    caught = sum(got[i] == got[j] for i, j in pairs)
    assert len(pairs) > 100 and caught >= 0.95 * len(pairs)


def test_sharp_sketch_against_a_plain_version():
    full = (1 << 64) - 1

    def mixed(h, k):
        z = (h + (k + 1) * 0x9E3779B97F4A7C15) & full
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & full
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & full
        return z ^ (z >> 31)

    text = " ".join(f"w{i * i % 977}" for i in range(150))
    h = simhash.shingle_set(text, 5).tolist()
    want = [sum(1 << b for b in range(64) if sum(mixed(x, k) >> b & 1 for x in h) * 2 > len(h)) for k in range(simhash.SHARP)]
    assert [int(v) & full for v in simhash.sharp_sketch(text, 5)] == want
    assert not simhash.sharp_sketch("", 5).any()


def test_sharp_sketch_follows_the_similarity():
    """Over 300 pairs: no bias, and three deviations are passed about as rarely as they should be (one pair in 740)."""
    bits, off = simhash.SHARP * simhash.BITS, []
    for seed in range(300):
        rng = random.Random(seed)
        text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))
        other = changed(rng, text, rng.choice([4, 6, 8]))
        a, b = (set(simhash.shingle_set(t, 5).tolist()) for t in (text, other))
        alike = len(a & b) / len(a | b)
        share = math.acos(2 * alike / (1 + alike)) / math.pi
        apart = sum(((int(x) ^ int(y)) & ((1 << 64) - 1)).bit_count() for x, y in zip(
            simhash.sharp_sketch(text, 5), simhash.sharp_sketch(other, 5)))
        off.append((apart - bits * share) / math.sqrt(bits * share * (1 - share)))
    assert abs(sum(off) / len(off)) < 0.3 and sum(o > 3 for o in off) <= 3


def test_only_finds_every_key_whatever_the_bitmap(spark):
    docs = spark.range(-500, 500).selectExpr("id * 7919 as k", "'x' as text")
    keys = docs.filter("k % 3 = 0").select("k")
    for bits in (3, 23):
        got = [r.k for r in simhash.only(docs, keys, "k", bits).collect()]
        assert sorted(got) == sorted(r.k for r in keys.collect())
    assert simhash.only(docs, keys.limit(0), "k").count() == 0


def test_crowded_lookups_are_one_row_a_text(frame, monkeypatch):
    """Sharp sketches join a row a text, however many crowded values it asks for."""
    real, seen = simhash.materialise, {}

    def kept(df, name, *rest):
        seen[name] = real(df, name, *rest)
        return seen[name]

    monkeypatch.setattr(simhash, "materialise", kept)
    rng = random.Random(3)
    base = " ".join(f"b{rng.randrange(10**6)}" for _ in range(300))
    simhash.similar_groups(frame(list(enumerate(changed(rng, base, 9) for _ in range(60)))), "doc_id")
    asks = seen["crowd-asks"]
    assert 0 < asks.count() == asks.select("node").distinct().count()


def test_texts_stay_in_place_where_keys_are_not_broadcast(spark):
    """Nothing is joined to the texts before the bitmap has dropped those that are not asked for."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.range(2000).selectExpr("id as k", "repeat('x', 50) as text")
        plan = simhash.only(docs, docs.filter("k % 40 = 0").select("k"), "k")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 2 and "__bucket" in joins[1] and "__bucket" not in joins[0]


def test_pairs_at_crowded_values_leave_once_a_text(frame, monkeypatch):
    made, real, pairs = [], simhash._met, simhash._crowd_pairs

    def kept(*how):
        made.append(pairs(*how))
        return made[-1]

    def met(*how):
        out = real(*how)
        rows = made[-1].groupBy("node", "other").count().collect()
        assert rows and max(r["count"] for r in rows) <= 2
        return out

    monkeypatch.setattr(simhash, "_crowd_pairs", kept)
    monkeypatch.setattr(simhash, "_met", met)
    monkeypatch.setattr(simhash, "DENSE", 2)
    rng = random.Random(3)
    base = " ".join(f"b{rng.randrange(10**6)}" for _ in range(300))
    simhash.similar_groups(frame(list(enumerate(changed(rng, base, 4) for _ in range(40)))), "doc_id").collect()
    assert made
