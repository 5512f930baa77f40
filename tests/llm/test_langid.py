import random
import zlib

import numpy as np
from quarry.llm import langid

SOUNDS = {"aa": ["ing", "the", "ed"], "ab": ["ung", "die", "ed"], "ba": ["ción", "que", "los"], "bb": ["tion", "que", "les"]}


def docs(spark, n=400):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = list(SOUNDS)[i % 4]
        rows.append((i, " ".join(rng.choice(SOUNDS[lang]) * 1 + rng.choice(["a", "o", "é"]) + rng.choice(SOUNDS[lang]) for _ in range(30)), lang, "s"))
    return rows


def test_held_out_accuracy_and_edge_rows(spark):
    rows = docs(spark) + [(9001, None, "aa", "s"), (9002, "12 %% 7", "aa", "s"), (9003, "", None, None), (9004, "the ingaed theoing", None, "s"), (9005, "que " * 30000, "bb", "s")]
    rows += [rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, letter string")
    out = langid.identify(df).collect()
    assert len(out) == len(rows)
    lang = {r[0]: r[2] for r in rows}
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.doc_id in (9001, 9002, 9003)) and r.lang_pred in {*SOUNDS, "und"}
    held = [r for r in out if r.held_out and r.doc_id < 9000]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert langid.identify(df.limit(0)).count() == 0
    none = langid.identify(df.where("lang is null"))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_one_language_and_families():
    x = np.stack([langid.vector(t.encode()) for t in ("the inged", "dieung", "quelos ción", "quelestion")] * 5)
    m = langid.fit(x, ["aa", "ab", "ba", "bb"] * 5)
    assert sum(map(len, m.families)) == 4 and m.predict(x)[0] == ["aa", "ab", "ba", "bb"] * 5
    assert langid.fit(x, ["aa"] * 20).predict(x)[0] == ["aa"] * 20
    assert np.array_equal(langid.vector("ÉÀ".encode()), langid.vector("éà".encode()))
