import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from quarry.llm.simhash import _difference_prefixes, _differences, _pairs_by_differences, _shortened, drop_near_duplicates, near_duplicates


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_groups_against_brute_force(spark):
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs = {}
    for _ in range(60):
        base = prose(rng.randint(60, 500))
        docs[len(docs)] = " ".join(base)
        for _ in range(rng.randrange(4)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs[len(docs)] = " ".join(w)
    docs |= {len(docs) + k: t for k, t in enumerate(["", " ", "one two", "One  two", "three"])}
    sets = {i: shingles(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(docs, 2):
        if alike(sets[a], sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    want = {i: root(i) for i in docs}
    rows = [(i, t, "en", 1) for i, t in docs.items()] + [(None, "left alone", "en", 1), (0, docs[0], "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, s int")
    got = {r.doc_id: r.group_id for r in near_duplicates(df).collect()}
    assert all(want[i] == want[g] for i, g in got.items())  # nothing is grouped that isn't alike
    dropped = {i for i, g in got.items() if g != i}
    should = {i for i, g in want.items() if g != i}
    assert dropped <= should and len(dropped) >= 0.97 * len(should)
    left = drop_near_duplicates(df)
    ids = [r.doc_id for r in left.collect()]
    assert left.columns == df.columns and sorted(i for i in ids if i is not None) == sorted(set(docs) - dropped) and ids.count(None) == 1
    assert drop_near_duplicates(df.limit(0)).count() == 0


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(17)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(400):
        w = list(base)
        for k in rng.sample(range(300), 2):
            w[k] = f"x{rng.randrange(5000)}"
        rows.append((i, " ".join(w)))
    left = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert left <= 8


def test_edits_in_one_place_and_drift_are_found(spark):
    rng = random.Random(19)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    docs = []
    for n in (30, 60, 200, 500, 1500):
        for _ in range(4):
            base, k = fresh(n), n // 12
            at = rng.randrange(n - k)
            docs += [base, base + fresh(n // 6), base[: n - n // 6], base[:at] + fresh(k - 4 if k > 4 else 1) + base[at + k :], base[at + k :] + base[:at]]
    for _ in range(4):
        # Each text has a shared half; those in sequence are alike, those far apart are not.
        base = fresh(300)
        for _ in range(12):
            docs.append(list(base))
            base = base[25:] + fresh(25)
    page = fresh(100)
    docs += [page + fresh(200) for _ in range(30)]
    rng.shuffle(docs)
    texts = [" ".join(w) for w in docs]
    sets = [shingles(t) for t in texts]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if alike(sets[a], sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.doc_id: r.group_id for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len({root(i) for i in range(len(docs))}) < len(docs) - 60
    assert {i: got.get(i, i) for i in range(len(docs))} == {i: root(i) for i in range(len(docs))}


def test_alike_texts_share_an_early_difference_from_a_leader(spark):
    rng = random.Random(23)
    texts = [set(range(60))]
    for _ in range(90):
        gone = rng.sample(range(30), rng.randrange(14))
        texts.append(set(range(60)) - set(gone) | {100 + x if rng.random() < 0.5 else rng.randrange(1000, 10**6) for x in gone})
    sets = spark.createDataFrame([(k, bytearray(_shortened(np.array(sorted(s), np.uint64)))) for k, s in enumerate(texts)], "t long, s binary")
    led = spark.createDataFrame([(0, k) for k in range(1, len(texts))], "u long, v long")
    rows = _difference_prefixes(_differences(led, sets, 0.8), 0.8).withColumn("part", F.col("t"))
    found = {(r.u, r.v) for r in _pairs_by_differences(rows, 0.8).collect()}
    pairs = [(a, b) for a, b in itertools.combinations(range(1, len(texts)), 2) if not (alike(texts[0], texts[a]) and alike(texts[0], texts[b]))]
    wanted = {(a, b) for a, b in pairs if alike(texts[a], texts[b])}
    assert wanted and wanted <= found and len(found) < len(pairs)
