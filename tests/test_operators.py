"""Operators on small fixtures: sources, dedup ties, names, spelling, sessions and resumable ingest."""

import difflib
import json
import random

from pyspark.sql import functions as F
from quarry import config as c
from quarry.functions import text as X
from quarry.operators import answers, dedup, examples, names, sampling, spell
from quarry.operators import search as S
from quarry.sources import records as R
from quarry.streaming import ingest, session

RECORD = 'Night Heron (Earth-77)\nPage: Heron (Bird) (Earth-77)\nFull name: Given "Nick" Family\nCodename: Grey; Tall-One\nAlso known as: Stilt (old)\nReality: Earth-6160\nPowers: a; b\nHistory:\nPage: not this; a long sentence about the marsh and its birds. Another long sentence about the sea and ships.'


def one(spark, text, **columns):
    return spark.createDataFrame([(0, "f", 0, text)], "doc_id long, file string, pos long, text string").select(*[v.alias(k) for k, v in columns.items()]).first()


def test_tokens_keys_and_surface(spark):
    t = F.col("text")
    r = one(spark, "Spider-Men's S.H.I.E.L.D. daredevils does glass", t=X.tokenize(t), n=X.norm(t), k=X.keys_of(F.lit("The Spider-Man")), q=X.query_key(F.lit("who created the moon knights")))
    assert r.t == ["spider-men", "spider", "men", "s", "s.h.i.e.l.d.", "daredevils", "daredevil", "does", "glass"]
    assert r.n == ["spidermen", "s", "s.h.i.e.l.d.", "daredevil", "doe", "glass"]
    assert sorted(r.k) == [["spider", "man"], ["spiderman"]] and r.q == ["moon", "knight"]
    r = one(spark, "x", h=X.humanize(F.lit("A; B; C")), h1=X.humanize(F.lit("A")), u=X.untitled(F.lit("Book Vol 6 32 is a comic. It was")), cl=X.clip(F.lit("one; two three four"), 10), sc=X.size_class(F.lit(0)))
    assert (r.h, r.h1, r.u, r.cl, r.sc) == ("A, B and C", "A", "Book Vol 6 32", "one; two", 1)


def test_record_files_round_trip(spark, tmp_path):
    body = "first\nline\n" + "=" * 60 + "\n\n" + "=" * 60 + " tail\nsecond\n" + "=" * 61 + "\n" + "z" * 1200
    (tmp_path / "b.txt").write_text(body)
    (tmp_path / "a.txt").write_text("tiny")
    blocks = R.with_doc_ids(R.read_record_files(spark, str(tmp_path)))
    got = [(r.doc_id, r.file, r.text) for r in blocks.orderBy("doc_id").collect()]
    assert got == [(0, "b.txt", "first\nline"), (1, "b.txt", "second"), (2, "b.txt", "z" * 1200)]
    R.write_record_files(blocks, str(tmp_path / "out"))
    back = R.read_record_files(spark, str(tmp_path / "out"), min_bytes=0)
    assert sorted(r.text for r in back.collect()) == sorted(x[2] for x in got)


def test_records_derive_their_columns(spark):
    r = R.records(spark.createDataFrame([(0, "f", 0, RECORD)], "doc_id long, file string, pos long, text string")).first()
    assert (r.headline, r.page, r.kind, r.field_count, r.is_main, r.has_page, r.is_entity) == ("Night Heron (Earth-77)", "Heron (Bird) (Earth-77)", "unknown", 6, True, True, True)
    assert r.narrative.startswith("Page: not this") and r.fields[0].label == "Page"


def test_names_of_records_and_index(spark):
    blocks = spark.createDataFrame([(0, "f", 0, RECORD), (1, "f", 1, "Grey\nPage: Grey\nA: 1\nB: 2\nHistory:\n" + "x" * 50), (2, "f", 2, "Stilt Vol 1 2 is a comic. Out now.")], "doc_id long, file string, pos long, text string")
    claims = names.names_of_records(R.records(blocks))
    got = {(" ".join(r.name), r.doc_id): r.prov for r in claims.collect()}
    assert got["night heron", 0] == 2 and got["heron", 0] == 2 and got["given nick family", 0] == 2 and got["nick family", 0] == 2
    assert got["grey", 0] == 1 and got["tallone", 0] == 1 and got["tall one", 0] == 1 and got["stilt", 0] == 0 and got["grey", 1] == 2 and got["stilt vol 1 2", 2] == 2
    index = names.name_index(claims)
    asked = spark.createDataFrame([(1, "who created night heron"), (2, "tell me about nothing known"), (3, "who is heron zyx"), (4, "heron")], "qid long, question string")
    found = {r.qid: r.doc_id for r in names.resolve(index, asked).collect()}
    assert found == {1: 0, 4: 0}
    assert {r.qid: r.confidence for r in names.confidence(index, asked).collect()}[2] == float("inf")


def test_bm25_against_a_plain_loop(spark):
    import math
    from collections import Counter

    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(30)]
    docs = {i: "\n".join([" ".join(rng.choice(vocabulary) for _ in range(3)), " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))]) for i in range(40)}
    df = spark.createDataFrame([(i, t, t.split("\n")[0], len(t)) for i, t in docs.items()], "doc_id long, text string, headline string, size int")
    asked = spark.createDataFrame([(0, "w1 w2 w3"), (1, "w4 w4"), (2, "nothing")], "qid long, question string")
    tok = {i: Counter(t.split()) for i, t in docs.items()}
    avg = sum(sum(v.values()) for v in tok.values()) / len(tok)
    for r in S.bm25_scores(df, asked).collect():
        want = 0.0
        for t in {0: {"w1", "w2", "w3"}, 1: {"w4"}}[r.qid]:
            n = sum(t in v for v in tok.values())
            idf = math.log(1 + (len(docs) - n + 0.5) / (n + 0.5))
            tf, size = tok[r.doc_id][t], sum(tok[r.doc_id].values())
            want += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / avg)) + (3 * idf if t in docs[r.doc_id].split("\n")[0].split() else 0)
        assert abs(r.score - want) < 1e-9


def test_dedup_keeps_the_first_and_short_blocks(spark):
    long = "l" * 250
    docs = spark.createDataFrame([(3, f"{long}\n\nshort"), (1, f"{long}\n\nshort"), (2, f"new {long}\n\n{long}"), (4, long)], "doc_id long, text string")
    assert sorted(r.doc_id for r in dedup.dedupe_documents(docs).collect()) == [1, 2, 4]
    out = {r.doc_id: r.text for r in dedup.dedupe_paragraphs(dedup.dedupe_documents(docs)).collect()}
    assert out == {1: f"{long}\n\nshort", 2: f"new {long}"}
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 9), (3, "a", 9), (4, None, 1), (5, "", 1)], "id long, key string, n long")
    assert sorted(r.id for r in dedup.biggest_of(rows, "key", "n", ("id",)).collect()) == [2, 4, 5]


def test_similar_words_are_difflibs(spark):
    rng = random.Random(2)
    known = sorted({"".join(rng.choice("abcdef") for _ in range(rng.randint(4, 9))) for _ in range(120)})
    lost = ["".join(w[:2] + w[3:]) for w in known[:25]] + [w + w[-1] for w in known[25:40]]
    got = {}
    for r in spell.similar_words(spark.createDataFrame([(w,) for w in lost], "word string"), spark.createDataFrame([(w,) for w in known], "term string")).collect():
        got.setdefault(r.word, []).append((r.rnk, r.term))
    for w in set(lost):
        assert [t for _, t in sorted(got.get(w, []))] == difflib.get_close_matches(w, known, n=8, cutoff=0.8)


def test_schedules_and_windows(spark):
    assert sampling.slice_chunks(1000, 100, 4) == [(0, 100), (300, 400), (600, 700), (900, 1000)]
    assert abs(sampling.replay_probability(0.5, 1.0) - 0.5) < 1e-12
    r = spark.range(1).select(sampling.masked_mean(F.lit(2.0), F.lit(0.0)).alias("m")).first()
    assert r.m == 0.0


def test_answers_refuse_and_passages_follow_terms(spark):
    asked = spark.createDataFrame([(1, "what powers does it have", RECORD), (2, "who created it", RECORD), (3, "hello", RECORD)], "qid long, question string, text string")
    got = {r.qid: r.answer for r in answers.field_answers(asked).collect()}
    assert got[1] == "Night Heron's powers include a and b." and "don't have" in got[2] and 3 not in got
    body = "The heron stood in the marsh for a very long time. The ship sailed away over the northern sea at dawn. Nobody in the village ever saw the vessel again."
    q = spark.createDataFrame([(1, "the ship and the sea", "Heron", "", body), (2, "who is heron", "Heron", "", body), (3, "what of dragons", "Heron", "", body)], "qid long, question string, headline string, page string, body string")
    got = {r.qid: r.passage for r in answers.passages(q).collect()}
    assert got[1] == "The ship sailed away over the northern sea at dawn." and got[2] == body and 3 not in got


def test_examples_are_stable_and_gated(spark):
    recs = spark.createDataFrame([(i, RECORD.replace("Night", f"N{i}"), i % 2) for i in range(200)], "doc_id long, text string, grp int")
    a, b = examples.dataset(recs, "grp").collect(), examples.dataset(recs.repartition(7), "grp").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    n = sum(r.kind == "open" for r in a)
    assert 80 <= n <= 140 and all(r.assistant for r in a)


def test_session_stream_equals_replay(spark, tmp_path):
    rows = [(c_, t, "x" + str(t) if (c_ + t) % 3 == 0 else None) for c_ in range(5) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, named string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = session.stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("turns").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.conv_id, r.turn, r.about, r.fresh, r.turns_kept)
    assert sorted(map(key, spark.table("turns").collect()), key=str) == sorted(map(key, session.replay(df).collect()), key=str)


def test_ingest_takes_each_file_once(spark, tmp_path):
    src, sink, ck = (tmp_path / x for x in ("src", "sink", "ck"))
    src.mkdir()
    line = lambda t: json.dumps({"file": "f", "title": t, "api": "a", "fetched_at": "x", "wikitext": "w"}) + "\n"
    (src / "1.json").write_text(line("a") + "broken\n" + line("b"))
    ingest.ingest(spark, str(src), str(sink), str(ck))
    (src / "2.json").write_text(line("c"))
    ingest.ingest(spark, str(src), str(sink), str(ck))
    assert sorted(r.title for r in spark.read.parquet(str(sink)).collect()) == ["a", "b", "c"]
    listed = spark.createDataFrame([("a", 0), ("d", 1), ("e", 2), ("d", 3), ("g", 4)], "title string, ord int")
    left = ingest.pending(listed, spark.createDataFrame([("a",)], "title string"), spark.createDataFrame([("e", "missing"), ("g", "http-500")], "title string, error string"))
    assert sorted((r.title, r.ord) for r in left.collect()) == [("d", 1), ("g", 4)]


def test_word_lists_hold_no_doubles():
    assert len(set(c.QUESTION_WORDS)) == len(c.QUESTION_WORDS)


def test_curated_pages_keep_the_whole_text(spark, tmp_path):
    from quarry.plans.dataset_plans import curated_pages

    said = " ".join(f"word{i}" for i in range(500))
    spark.createDataFrame([(1, f"<html><body><p>{said}</p></body></html>")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    (row,) = curated_pages(spark, str(tmp_path)).collect()
    assert row.text.rstrip().endswith(said)
