import random
import re

import numpy as np
import xxhash
from quarry.llm import substring as s
from quarry.llm import words as lib


def lower(x):
    return "".join(c.lower() if c < "\x80" else c for c in x)


def picked(a, b):
    """Whether word b, after a, ends a sentence in a long stretch."""
    h = lambda x: xxhash.xxh64_intdigest(lower(x).encode(), 42)
    return int(lib.mix(np.array([(h(b) + h(a) * 0xC2B2AE3D27D4EB4F) % 2**64], dtype=np.uint64))[0]) % s.PICK == 0


def pieces(text):
    """(start, end of text, words) of each sentence, by characters."""
    stretches, last = [], None
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        if last is None or "\n" in text[last.end() : m.start()] or last[0][-1] in ".!?":
            stretches.append([])
        stretches[-1].append((m.start(), m[0]))
        last = m
    out = []
    for x in stretches:
        for k, (at, word) in enumerate(x):
            if k == 0 or len(x) > s.LONG and k >= 2 and picked(x[k - 2][1], x[k - 1][1]):
                out.append((at, []))
            out[-1][1].append(lower(word))
    return out


def brute(docs):
    seen, gone = set(), {}
    for d, t in sorted(docs.items()):
        p = pieces(t)
        gone[d] = set()
        for i in range(len(p)):
            m = next((m for m in range(s.SPAN, len(p) - i + 1) if sum(len(x[1]) for x in p[i : i + m]) >= s.MIN_WORDS), None)
            if m:
                run = tuple(tuple(x[1]) for x in p[i : i + m])
                if run in seen:
                    gone[d] |= set(range(i, i + m))
                seen.add(run)
    out = {}
    for d, t in docs.items():
        p = pieces(t)
        edge = [x[0] for x in p] + [len(t)]
        out[d] = (t[: edge[0]] + "".join(t[edge[i] : edge[i + 1]] for i in range(len(p)) if i not in gone[d]) if gone[d] else t, len(p), len(gone[d]))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(7)
    sentence = lambda: " ".join(rng.choice(["ab", "Bé", "c,", "d"]) + str(rng.randrange(1000)) for _ in range(rng.randint(1, 25))) + rng.choice([". ", "!\n", "? ", "\n"])
    passage = ["".join(sentence() for _ in range(8)) for _ in range(3)]
    docs = {}
    for i in range(60):
        parts = [sentence() for _ in range(rng.randint(0, 12))]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, len(parts)), rng.choice(passage))
        docs[i] = "".join(parts)
    docs |= {100: docs[5], 101: "", 102: "  \n", 103: "one two. " * 40, 104: "w " * 3000, 105: docs[6].upper()}
    rows = [(i, t, 1) for i, t in docs.items()] + [(200, None, 1), (5, docs[5], 1)]
    out = s.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string, i int")).collect()
    assert len(out) == len(rows)
    want = brute(docs)
    for r in out:
        if r.doc_id == 200:
            assert r.text is None
        else:
            assert (r.text, r.n_sentences, r.n_removed) == want[r.doc_id], r.doc_id
            assert r.removed_chars == len(docs[r.doc_id]) - len(r.text)
    assert want[100][0].strip() == "" or len(pieces(docs[5])) < s.SPAN
    assert s.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_rows_that_share_an_id_are_cut_by_their_own_text(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" + ("." if k % 6 == 5 else "") for k in range(48))
    rep, own, third, other = text(), text(), text(), text()
    rows = [(1, rep), (7, rep), (7, own), (None, third), (None, other), (None, None), (3, third), (4, other + " " + rep)]
    out = s.dedup_substrings(spark.createDataFrame(rows + [rows[1]], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == sorted([(1, rep), (7, ""), (7, ""), (7, own), (0, third), (0, other), (0, ""), (3, ""), (4, "")])


def test_passages_of_fifty_words_go_wherever_they_begin(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**5)}"
    kinds = {
        "short": lambda n: " ".join(word() + rng.choice("!.?") if rng.random() < 0.6 else word() for _ in range(n)), "list": lambda n: "\n".join(word() for _ in range(n)),
        "plain": lambda n: " ".join(word() for _ in range(n)), "prose": lambda n: " ".join(word() + ("." if rng.random() < 0.1 else "") for _ in range(n)),
    }
    docs, places = [], {}
    for name, make in kinds.items():
        for _ in range(25):
            passage = make(60)
            for _ in range(2):
                before = make(rng.randrange(5, 90))
                docs.append((len(docs), before + " " + passage + " " + make(rng.randrange(5, 60))))
            places[len(docs) - 1] = (name, set(re.findall(r"w[0-9]+", passage)))
    left = {r.doc_id: set(re.findall(r"w[0-9]+", r.text)) for r in s.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    gone = {name: [1 - len(left[i] & w) / len(w) for i, (k, w) in places.items() if k == name] for name in kinds}
    for name, shares in gone.items():
        assert sum(x > 0.5 for x in shares) >= 0.9 * len(shares), (name, shares)
    assert all(len(left[i]) for i, _ in docs)


def shuffled_bytes(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_runs_that_occur_once_are_shuffled_by_a_few_bytes(spark):
    rng = random.Random(10)
    rows = [(i, "\n".join(f"{rng.randrange(10**8):08x}" for _ in range(400))) for i in range(300)]
    rows.append((300, rows[0][1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(4).localCheckpoint()
    before = shuffled_bytes(spark)
    out = {r.doc_id: r for r in s.dedup_substrings(docs).collect()}
    assert shuffled_bytes(spark) - before < sum(len(t) for _, t in rows)
    assert [i for i, r in out.items() if r.n_removed] == [300] and out[300].text == "" and all(out[i].text == t for i, t in rows[:300])


def test_members_are_never_missed(spark):
    from quarry.llm import members as m

    rng = np.random.default_rng(11)
    h = rng.integers(0, 2**64, 30_000, dtype=np.uint64)
    h[:3] = 0, 1, 2**64 - 1
    parts = [h[:20_000], h[10_000:], h[:1], h[2:3], h[2:3]]
    rows = [(b, s) for part in (parts[:1], parts[1:2], parts[2:]) for batch in m.packed(iter(part)) for b, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
    assert not m.members(spark.createDataFrame([], "b int, s binary"), 2).has(h).any()
    table = spark.createDataFrame(rows, "b int, s binary")
    assert m.members(table, 1).has(h).all()
    found = m.members(table, 2).has(h)
    assert found[10_000:20_000].all() and found[0] and found[2] and found.sum() < 11_500
