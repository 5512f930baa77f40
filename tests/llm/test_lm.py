import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from quarry.llm import lm


def tokens(t):
    return [*(t or "").encode().lower().split(), None]


def test_table_finds_every_key():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    t = lm.Table(keys[:4000], np.arange(4000))
    assert (t.get(keys[:4000], -1) == np.arange(4000)).all()
    assert (t.get(keys[4000:], -1) == -1).all()
    assert (lm.Table(keys[:0], np.zeros(0, np.int64)).get(keys, -1) == -1).all()


def test_normalisers_sum_to_one(spark):
    p = lm.start_parameters(np.full(512, 1 / 512))
    a, b, z = lm.normalisers(spark, p)
    s = (a[5] + b[9]) @ p["Q"].T + p["b"] - z[5, 9]
    assert abs(np.exp(s).sum() - 1) < 1e-4
    assert set(map(len, p["R"])) == {lm.DIMENSIONS} and all((lm.unpack(lm.pack(p))[k] == p[k]).all() for k in p)


def test_classes_grow_with_the_vocabulary():
    assert [lm.outputs_of(n) for n in (0, 1000, 300_000, 1_000_000, 5_000_000, 10**9)] == [512, 512, 512, 1024, 2048, 2048]


def test_score_is_what_the_fitted_parameters_say(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEAST_OUTPUTS", 128), monkeypatch.setattr(lm, "MOST_OUTPUTS", 128), monkeypatch.setattr(lm, "SHARD_TOKENS", 3000), monkeypatch.setattr(lm, "_FAN_IN", 2)
    fitted, train = [], lm.train
    monkeypatch.setattr(lm, "train", lambda *a: fitted.append(train(*a)) or fitted[-1])
    rng = random.Random(3)
    vocabulary = [f"{rng.choice('abcdefgh')}{k}{rng.choice('xyz')}" for k in range(200)]
    docs = {i: " ".join(vocabulary[min(int(rng.expovariate(0.02)), 199)] for _ in range(rng.randint(0, 200))) for i in range(150)} | {150: "never seen-before words", 151: ""}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    out = {r.doc_id: r.score for r in lm.score(df.repartition(3)).collect()}
    again = {r.doc_id: r.score for r in lm.score(df.repartition(17)).collect()}
    assert all(again[i] == pytest.approx(x, rel=1e-9) for i, x in out.items())
    assert (lm.pack(fitted[0]) == lm.pack(fitted[1])).all()
    p, head = fitted[0], 64
    c = Counter(x for i, t in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1 for x in tokens(t))
    of_hash = lambda x: int(lm.END_HASH) if x is None else xxhash.xxh64_intdigest(x, 42)
    own = {x: k for k, x in enumerate(sorted(c, key=lambda x: (-c[x], of_hash(x)))[:head])}

    def rare(x):
        if x is None:
            return 0
        last, two = x[-1], x[max(len(x) - 2, 0)]
        return (last * 31 + two * 7 + (last * two) // 16) % lm.CLASSES

    n_class, v_class = Counter(), Counter()
    for x, n in c.items():
        if x not in own:
            n_class[rare(x)] += n
            v_class[rare(x)] += 1
    p = {k: v.astype(np.float64) for k, v in p.items()}
    cls = lambda x: own.get(x, head + rare(x))
    seen = {}

    def log_classes(one, two):
        if (one, two) not in seen:
            s = p["Q"] @ (p["R"][one] @ p["C"][0] + p["R"][two] @ p["C"][1]) + p["b"]
            seen[one, two] = s - np.log(np.exp(s).sum())
        return seen[one, two]

    within = lambda x: 0.0 if x in own else math.log((c[x] + 0.5) / (n_class[rare(x)] + 0.5 * (v_class[rare(x)] + 1)))
    for i, t in docs.items():
        one = two = 128
        total = 0.0
        for x in tokens(t):
            total += log_classes(one, two)[cls(x)] + within(x)
            one, two = cls(x), one
        assert out[i] == pytest.approx(total / math.log(10), abs=1e-3 + 1e-5 * abs(total)), i
    # All training words, and one unseen word of each class, have a probability of one together.
    whole = sum(math.exp(log_classes(3, 5)[cls(x)] + within(x)) for x in c) + sum(math.exp(log_classes(3, 5)[head + k]) * 0.5 / (n_class[k] + 0.5 * (v_class[k] + 1)) for k in range(lm.CLASSES))
    assert whole == pytest.approx(1, abs=1e-6)


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 40)
    rng = random.Random(2)
    vocabulary = ["the", "of", "und", "der"] * 12 + [f"w{k}" for k in range(150)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80))) for _ in range(150)] + [None, "", "THE  the\nThe", "only-here only-here", "x " * 4000]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(4, texts[4], 6)]
    out = lm.score(spark.createDataFrame(rows, "doc_id long, text string, h long")).collect()
    assert len(out) == len(rows)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _, _ in rows}
    c = Counter(x for i, t, _ in rows if not held[i] for x in tokens(t))
    n, v = sum(c.values()), len(c)
    for r in out:
        own = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(c[x] > 0 for x in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own), rel=1e-9)
        assert r.score < 0


def test_model_beats_the_base_where_context_tells(spark):
    rng = random.Random(4)
    one, two = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choice(one if i % 2 else two) for _ in range(150))) for i in range(300)]
    out = [r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_empty_table_and_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm.score(docs.limit(0)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
