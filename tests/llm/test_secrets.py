import hashlib
import random
import re

from quarry.llm import secrets as s


def brute(t):
    t = t or ""
    found = []
    key = "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])"
    for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 8:
            found.append((m.start(), m.end(), 0))
    found += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 32]
    return [f"{s.KINDS[k]}:{a}:{b}" for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def texts():
    rng = random.Random(5)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    out = [f'so é token = "{hexes(40)}" and so on' for _ in range(60)]
    out += [f"AKIA{''.join(rng.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789') for _ in range(16))} x" for _ in range(30)]
    out += ["PASSWORD:short", "Api_Key='abcdefgh1'", "apikey = =abcdefgh", "token=tokenabc secret=token=abcdefgh", f"ſecret=abcdefghij {hexes(31)} {hexes(32)}", "AKIAAKIA", "AKIA" + "A" * 12]
    return [*out, None, "", "plain words and nothing else " * 2000, hexes(64) + "g" + hexes(40)]


def test_base_spans_match_brute_force_and_stay(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(0, texts()[0], "x")]
    out = s.secret_digests(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(out) == len(rows)
    for r in out:
        want = brute(dict((a, b) for a, b, _ in rows)[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in s.KINDS]
        assert [x for x in r.spans.split(",") if x and not x.startswith("learned")] == want
    assert s.secret_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automaton_tells_format_from_words():
    rng = random.Random(6)
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    a = s.infer([hexes() for _ in range(300)])
    b = s.infer(["-".join("".join(rng.choice("etaoin") for _ in range(5)) for _ in range(5)) for _ in range(300)])
    assert len(a.ends) < 200
    x = hexes()
    assert a.bits(x) - b.bits(x) > s.MARGIN_BITS
    assert a.bits("plain-words-with-one-1-digit") < b.bits("plain-words-with-one-1-digit")


def test_learned_format_finds_unmarked_credentials(spark):
    rng = random.Random(8)
    ticket = lambda: "".join(rng.choice("GHJKMNPQRSTVWXYZ0123456789") for _ in range(24))
    rows = [(i, f"api_key: {ticket()} ok") for i in range(100)] + [(1000, f"left lying: {ticket()} here"), (1001, "half-finished-sentences-of-2-kinds")]
    out = {r.doc_id: r.spans for r in s.secret_digests(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 1000").collect()}
    assert out[1000] == "learned:12:36" and out[1001] == ""


def test_redact_removes_every_base_span(spark):
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts())], "doc_id long, text string, n_chars long")
    out = s.redact(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        before = dict(enumerate(texts()))[r.doc_id]
        assert (r.text is None) == (before is None)
        if before is not None:
            assert r.n_chars == len(r.text) and not re.search("[0-9a-f]{32}", r.text)
            assert brute(before) or r.text == before


def test_short_and_dotted_and_letter_credentials_are_candidates(spark):
    rng = random.Random(18)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 12))) for _ in range(600)]
    prose = lambda: " ".join(rng.choice(vocabulary) for _ in range(60))
    short = lambda: "".join(rng.choice("GHJKMNPQRSTVWXYZ0123456789") for _ in range(10))
    caps = lambda: "".join(rng.choice("GHJKMNPQRSTVWXYZ") for _ in range(12))
    dotted = lambda: ".".join("".join(rng.choice("GHJKMNPQRSTVWXYZ0123456789") for _ in range(5)) for _ in range(3))
    rows = [(i, f"{prose()} api_key: {make()} {prose()}.") for i, make in enumerate([short, caps, dotted] * 80)]
    lost = [short(), caps(), dotted()]
    rows += [(1000 + i, f"{prose()}. left {x} here") for i, x in enumerate(lost)]
    rows += [(2000 + i, prose() + " internationally.") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.spans for r in s.secret_digests(docs).where("n_learned > 0").collect()}
    at = {k: dict(rows)[k].index(x) for k, x in zip((1000, 1001, 1002), lost)}
    assert out == {k: f"learned:{at[k]}:{at[k] + len(x)}" for k, x in zip(at, lost)}
    left = {r.doc_id: r.text for r in s.redact(docs).where("doc_id >= 1000").collect()}
    assert not any(x in left[k] for k, x in zip(at, lost)) and all(left[2000 + i] == dict(rows)[2000 + i] for i in range(200))


def test_redact_cuts_what_find_secrets_finds_with_few_labels_too(spark):
    rng = random.Random(28)
    prose = lambda: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9))) for _ in range(30))
    ticket = lambda: "".join(rng.choice("GHJKMNPQRSTVWXYZ0123456789") for _ in range(24))
    for labels, least, most in ((1, 0, 10), (12, 5, 10)):
        rows = [(i, f"{prose()} api_key: {ticket()} {prose()}") for i in range(labels)] + [(100 + i, f"{prose()} {ticket()} xAKIA{ticket()} {prose()}") for i in range(10)] + [(200, None), (201, "")]
        rows += [(300 + i, prose()) for i in range(200)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        spans = {r.doc_id: [(s["start"], s["stop"]) for s in r.spans] for r in s.find_secrets(docs).collect()}
        assert least <= sum(len(spans[100 + i]) >= 2 for i in range(10)) <= most, (labels, spans)
        text = dict(rows)
        for r in s.redact(docs).collect():
            want, last = "", 0
            for a, b in spans[r.doc_id]:
                if a >= last:
                    want += text[r.doc_id][last:a] + "[SECRET]"
                last = max(last, b)
            assert r.text == (None if text[r.doc_id] is None else want + text[r.doc_id][last:])
