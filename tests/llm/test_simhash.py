import itertools
import random

import xxhash
from quarry.llm.components import components
from quarry.llm.simhash import links, simhash_components


def brute_fp(text, width=3):
    w = [x for x in (text or "").encode().lower().split()]
    runs = [b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*edges, (7, 7), (None, 3)], "u long, v long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {k: v for k, v in brute_components(nodes, [e for e in edges if e[0] != e[1]]).items()}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 8)):
            fps.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                x ^= 1 << b
    fps |= {0, 1, 1 << 63, (1 << 64) - 1, (1 << 63) | 3}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = [(r.fp_a, r.fp_b) for r in links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()]
    true = [(a, b) for a, b in itertools.combinations(fps, 2) if bin(a ^ b).count("1") <= 2]
    assert all(bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2 for a, b in got)
    nodes = [signed(x) for x in fps]
    assert brute_components(nodes, got) == brute_components(nodes, [(signed(a), signed(b)) for a, b in true])


def test_simhash_components_match_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts = base + [t + " tail" for t in base[:20]] + [t.upper() for t in base[:10]] + [None, "", "\t \n", "One", "one two", "É é  x\x0by", "z " * 3000]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    out = simhash_components(docs).collect()
    assert len(out) == len(rows)
    fp = {i: brute_fp(t) for i, t, _ in rows}
    assert all(int(r.fingerprint, 16) == fp[r.doc_id] and len(r.fingerprint) == 16 for r in out)
    linked = [(a, b) for a, b in itertools.combinations(fp, 2) if bin(fp[a] ^ fp[b]).count("1") <= 2]
    assert {r.doc_id: r.component_id for r in out} == brute_components(list(fp), linked)
    assert simhash_components(docs.limit(0)).count() == 0


def test_narrow_fingerprints_meet_at_an_anchor():
    import numpy as np
    from quarry.llm.simhash import anchors

    rng = random.Random(21)
    for bits in (31, 40, 62, 63, 64):
        for x in [0, (1 << bits) - 1, *(rng.getrandbits(bits) for _ in range(4))]:
            near = [x ^ (1 << i) ^ (1 << j if j != i else 0) for i in range(bits) for j in range(i, bits)]
            row, anchor = anchors(np.array([x, *near], dtype=np.uint64), bits)
            at = {}
            for r, a in zip(row.tolist(), anchor.tolist()):
                at.setdefault(r, set()).add(a)
            assert all(at[0] & at[k] for k in range(1, len(near) + 1)), bits


def test_narrow_links_connect_what_brute_force_connects(spark):
    rng = random.Random(22)
    fps = set()
    for _ in range(150):
        x = rng.getrandbits(40)
        fps |= {x, x ^ (1 << rng.randrange(40)), x ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20, 40))}
    got = [(r.fp_a, r.fp_b) for r in links(spark.createDataFrame([(0, x) for x in fps], "block long, fp long"), 40).collect()]
    true = [(a, b) for a, b in itertools.combinations(fps, 2) if bin(a ^ b).count("1") <= 2]
    assert brute_components(fps, got) == brute_components(fps, true)
