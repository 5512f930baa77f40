import random
import re
from collections import Counter

from quarry.llm import quality as q


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(spark):
    rng = random.Random(1)
    words = ["a", "bé", "c%", "ü#", "Dd", "日本", "x y"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += [None, "", " \n\n", "a " * 50, "line\nline\nline\n \n", "one " * 7 + "two", "long " * 20000]
    rows = [(i, t, None if i % 7 == 0 else "en", "s" if i % 5 else None, 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    out = q.quality(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    kept = q.filter_quality(docs)
    assert kept.columns == docs.columns
    again = {r.doc_id: r.kept for r in out if r.doc_id != 3}
    assert {r.doc_id for r in kept.collect()} - {3} == {k for k, v in again.items() if v}
    assert q.quality(docs.limit(0)).count() == 0 and q.filter_quality(docs.limit(0)).count() == 0


def test_sketch_quantiles_are_close_and_merge(spark):
    rng = random.Random(2)
    rows = [("en" if i % 2 else "de", f"s{i % 3}", rng.random()) for i in range(6000)]
    stats = spark.createDataFrame([(a, b, 100, int(x * 1000), 1000, 0, 10, 0, 0) for a, b, x in rows], "lang string, source string, _n_words long, _n_symbols long, _word_chars long, _n_dup_lines long, _n_lines long, _n_repeat_words long, _n_upper long")
    s = q.sketches(stats)
    got = {r.lang: r for r in q._quantiles(s, ["lang"]).where("ratio = 'symbol_ratio'").collect()}
    for lang in ("en", "de"):
        xs = sorted(int(x * 1000) / 100 for a, _, x in rows if a == lang)
        assert abs(got[lang].q50 - xs[len(xs) // 2]) <= 0.05 * xs[len(xs) // 2] + 0.05
        assert got[lang].total == len(xs)


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(3)
    prose = lambda: " ".join("".join(rng.choice("etaoinshrd") for _ in range(rng.randint(2, 8))) for _ in range(100))
    rows = [(i, prose(), "en", f"s{i % 2}") for i in range(300)]
    rows += [(1000 + i, prose().replace(" ", "%%% "), "en", "s1") for i in range(30)] + [(2000 + i, prose().upper(), "en", "s1") for i in range(30)]
    kept = {r.doc_id for r in q.filter_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert kept == set(range(300))


def test_sources_have_thresholds_of_their_own(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinshrd") for _ in range(rng.randint(2, 8)))
    prose = lambda share: " ".join(word() + ("%" if rng.random() < share else "") for _ in range(100))
    rows = [(i, prose(0.0), "en", "news") for i in range(200)] + [(1000 + i, prose(0.1 + 0.3 * rng.random()), "en", "code") for i in range(300)]
    same = prose(0.25)
    rows += [(5000, same, "en", "news"), (5001, same, "en", "code")] + [(6000 + i, prose(0.0), "en", f"small{i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    verdict = {r.doc_id: r.kept for r in q.quality(docs).collect()}
    assert (verdict[5000], verdict[5001]) == (False, True)
    top = {r.source: r for r in q.limits(q.sketches(q.measured(docs.select("lang", "source", "text"), "text"))).collect()}
    # A small source follows its language, a large one itself.
    assert 2 * top["news"].max_symbol_ratio < min(top["small0"].max_symbol_ratio, top["code"].max_symbol_ratio)
    assert len({round(r.max_word_chars_mean, 6) for r in top.values()}) >= 3
