import random
import re

from quarry.llm import decontaminate as d


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def data():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, prose(n) + ".") for k, n in enumerate([10, 18, 30, 45, 60, 7, 3, 0])] + [(50, None), (3, None)]
    docs = []
    for i in range(150):
        t = prose(rng.randint(0, 200))
        if i % 3 == 0:
            w = (items[i % 5][1]).split()
            if i % 2:
                w = [x if rng.random() > 0.15 else "CHANGED" for x in w]
            t = t + "\n" + ", ".join(w).upper() + " " + prose(20)
        docs.append((i, t, 0))
    docs += [(900, None, 0), (901, "", 0), (902, items[5][1], 0), (904, prose(5) + " " + items[6][1] + " " + prose(5), 0), (903, prose(20000) + " " + items[4][1], 0), docs[0]]
    return docs, items


def brute(docs, items):
    """Best alignment of every item with every document, over all shifts."""
    found = {}
    for i, t, _ in docs:
        w = words(t)
        for k, it in items:
            x = words(it)
            if len(x) < d.SPAN:
                if x and any(w[s : s + len(x)] == x for s in range(len(w))):
                    found[i, k] = len(x)
                continue
            best = max((sum(a == b for a, b in zip(w[max(s, 0) :], x[max(-s, 0) :])), -s) for s in range(-len(x) + 1, max(len(w), 1)))
            if best[0] >= d.MIN_SHARE * len(x):
                found[i, k] = max(best[0], found.get((i, k), 0))
    return found


def test_overlaps_match_brute_force(spark, monkeypatch):
    docs, items = data()
    di = spark.createDataFrame(docs, "doc_id long, text string, h int")
    it = spark.createDataFrame(items, "item_id long, text string")
    want = brute([x for x in docs if x[0] != 903], items) | {(903, 4): 60}
    out = {(r.doc_id, r.item_id): r.n_matched for r in d.overlaps(di, it).collect()}
    assert out == want
    monkeypatch.setattr(d, "BROADCAST_BYTES", -1)
    assert {(r.doc_id, r.item_id): r.n_matched for r in d.overlaps(di, it).collect()} == want
    left = d.decontaminate(di, it)
    assert left.columns == di.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(x[0] for x in docs if x[0] not in {a for a, _ in want})
    assert d.overlaps(di.limit(0), it).count() == 0 and d.overlaps(di, it.limit(0)).count() == 0
    plan = d.overlaps(di, it)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_each_row_is_judged_by_its_own_text(spark):
    rng = random.Random(12)
    prose = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    item = prose(30)
    rows = [(None, prose(50)), (None, item + " " + prose(5)), (None, None), (7, prose(40)), (7, prose(9) + " " + item), (7, item), (8, prose(40)), (8, prose(40)), (9, "")]
    rows += [rows[6], rows[1]]
    df = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, bad_id string, n int")
    it = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = d.decontaminate(df, it)
    assert left.columns == df.columns
    assert sorted(r.n for r in left.collect()) == [0, 2, 3, 6, 7, 8, 9]
    found = {(r.doc_id, r.n_matched, r.doc_word) for r in d.overlaps(df, it).collect()}
    assert found == {(None, 30, 0), (7, 30, 0)}
    assert d.decontaminate(df, it.limit(0)).count() == len(rows)


def test_recall_of_substituted_items(spark):
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(10**6)}"
    items = [(k, [word() for _ in range(n)]) for k, n in enumerate([16, 20, 30, 45] * 25)]
    docs, kept = [], {}
    for k, w in items:
        for share in (0.2, 0.4):
            x = [v if rng.random() > share else word() for v in w]
            docs.append((len(docs), " ".join([word() for _ in range(10)] + x + [word() for _ in range(10)])))
            if 2 * sum(a == b for a, b in zip(w, x)) >= len(w):
                kept[docs[-1][0]] = (share, len(w))
    it = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    found = {r.doc_id for r in d.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), it).collect()}
    of = lambda share, least: (lambda ids: sum(i in found for i in ids) / len(ids))([i for i, (s, n) in kept.items() if s == share and n >= least])
    assert found <= set(kept) and of(0.2, 16) >= 0.98 and of(0.4, 20) >= 0.95 and of(0.4, 16) >= 0.9
