import random

import pytest
from pyspark.sql import functions as F
from quarry.functions import surface as U
from quarry.operators import sampling as P
from quarry.operators import search as S
from quarry.operators.ranks import range_of, with_places


def test_a_stored_index_gives_the_same_scores(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{k}s" if k % 3 else f"a-b{k}" for k in range(80)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), f"Head {rng.choice(words)} ({i % 3})") for i in range(60)] + [(99, None, "x")], "doc_id long, text string, headline string")
    asked = spark.createDataFrame([(k, f"who is w{k}s or a-b{k}") for k in range(8)], "qid long, question string")
    folder = f"file://{tmp_path}/index"
    rows = lambda df: sorted((r.qid, r.doc_id, round(r.score, 9)) for r in df.collect())
    want = rows(S.bm25_scores(docs, asked))
    assert want and rows(S.bm25_scores(S.save_index(docs, folder), asked)) == want
    again = S.load_index(spark, folder)
    assert rows(S.boosted_scores(docs, asked, again)) == rows(S.boosted_scores(docs, asked))
    assert again.docs.where("doc_id = 99").first().len == 0
    # A second build takes the first one's place.
    again = S.save_index(docs.where("doc_id < 10"), folder)
    assert again.one.first().n == 10
    again.one.withColumn("version", F.lit(1)).write.mode("overwrite").parquet(f"{folder}-old/one")
    for name in ("postings", "docs", "heads", "terms"):
        again.docs.write.mode("overwrite").parquet(f"{folder}-old/{name}")
    with pytest.raises(ValueError):
        S.load_index(spark, f"{folder}-old")


def test_places_and_sums_match_sorting(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i if rng.random() < 0.9 else -i, rng.randrange(100)) for i in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "g string, o long, w int")
    for by in ("g", None):
        seen, want = {}, {}
        for g, o, w in sorted(rows, key=lambda r: r[1]):
            n, s = seen.get(g if by else 0, (0, 0))
            want[o] = (n, s)
            seen[g if by else 0] = (n + 1, s + w)
        got = {r.o: (r.place, r.before) for r in with_places(df, by, ["o"], range_of(df, "o"), F.col("w")).collect()}
        assert got == want
    assert with_places(df.limit(0), "g", ["o"], range_of(df.limit(0), "o")).count() == 0


def test_windows_are_drawn_within_their_stream(spark):
    s = spark.createDataFrame([(k, list(range(k, k + n)), [0, 1] * (n // 2)) for k, n in ((0, 40), (1, 18), (2, 10))], "doc_id long, tokens array<int>, mask array<int>")
    for r in P.random_windows(s, 16, 5, mask=True).collect():
        assert r.y == [x + 1 for x in r.x] and r.x == list(range(r.x[0], r.x[0] + 16)) and r.m == [(v - r.doc_id) % 2 for v in r.y]
    with pytest.raises(Exception, match="differ in length"):
        P.random_windows(s.withColumn("mask", F.slice("mask", 1, 3)), 16, 1, mask=True).collect()
    own, other = (spark.createDataFrame([(k, [c * 1000 + k * 50 + i for i in range(30)]) for k in range(4)], "stream_id long, tokens array<int>") for c in (1, 2))
    rows = P.replay_windows(own, other, 8, 400, 0.25).collect()
    assert len(rows) == 400 and all({v // 1000 for v in r.x + r.y} == {2 if r.replayed else 1} for r in rows) and 60 < sum(r.replayed for r in rows) < 140
    with pytest.raises(ValueError):
        P.replay_windows(own, other, 8, 1, 1.5)


def test_surface_rules(spark):
    one = lambda c, **v: spark.range(1).select(*[F.lit(x).alias(k) for k, x in v.items()]).select(c.alias("x")).first().x
    t = F.col("t")
    for text, want in (("a..", "a."), ("a...", "a..."), ("a....", "a..."), ("What If...?.", "What If...?"), ("no!?..", "no!?"), ("x. y.. z", "x. y. z")):
        assert one(U.one_terminator(t), t=text) == want
    assert one(U.agree(t), t="They is here and they hasn't gone") == "They are here and they haven't gone"
    for value, want in (("Mutant", "a Mutant"), ("asgardian", "an asgardian"), ("Humans", "Humans"), ("Boss", "a Boss"), ("the one", "the one"), ("", "")):
        assert one(U.with_article(t), t=value) == want
    for q, want in (("", True), (" Hi! ", True), ("ok cool thanks", True), ("ok cool thanks bye", False), ("hi bob", False)):
        assert one(U.is_chitchat(t), t=q) == want
    assert one(U.is_chitchat(t, ("who are you",)), t="Who  are you??")
    assert one(U.display_name(t), t="who is Blorptron the Unmaker") == "Blorptron Unmaker"
    record = "Name (Earth-1)\nFull name: Ann\nFull name: Bo\nNotes: x\nPowers: y\nHistory:\n===A===; First. " + "word " * 120
    assert one(U.parsed_fields(t), t=record) == {"Full name": "Ann"}
    assert one(U.describe(t), t=record) == "Ann" and one(U.title_of(t), t="X is a thing. More\nPage: Y (Z)") == "Y (Z)"
    assert one(U.history_excerpt(t), t=record).startswith("First. word") and len(one(U.history_excerpt(t), t=record)) <= 420
