import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from quarry.llm import packing
from quarry.llm.hilbert import hilbert_key


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_hilbert_visits_every_cell_by_unit_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = hilbert_key(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    walk = cells[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def texts():
    rng = random.Random(3)
    vocabulary = ["the", "The", "l'été", "don't", "x%%%", "ab1c2", "ÉÀ", "naïve,", "<|endoftext|>", "<|EndOfText|>", "été", "日本語", "ß", " x y", "a\x1cb", "(((", "'s", "«q»", "x×y", "é÷", "été!?", "ab's.", "a-b", "n°5", "Ÿ...", "İI", "ΣΑΣ"]
    vocabulary += ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 12))) for _ in range(80)]
    out = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120))) for _ in range(120)]
    return [*out, None, "", " \n\t", "same same\nsame", "same same\nsame", "long words " * 9000]


def brute(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def test_word_ids_are_the_tokenizers():
    own = packing.UnitIds(packing.tokenizer_path(packing.TOKENIZER))
    ts = texts()
    for part in (ts[:50], ts[50:], ts):
        ids, total = own.encode([(x or "").encode() for x in part])
        assert [x.tolist() for x in np.split(ids, np.cumsum(total)[:-1])] == brute(part)


def test_pieces_hold_every_token_once(spark):
    ts = texts()
    rows = [(i, t, 0) for i, t in enumerate(ts)] + [(0, ts[0], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    ids = brute(ts)
    out = packing.pack_digests(docs, context=256).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        assert r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for d, got in by_doc.items():
        times = 2 if d == 0 else 1
        assert sum(n for _, n in got) == times * len(ids[d])
        covered = sorted(x for a, n in got for x in range(a, a + n))
        assert covered == sorted(list(range(len(ids[d]))) * times)
    sizes = []
    for got in by_seq.values():
        at = 0
        for a, n in sorted(got):
            assert a == at
            at += n
        sizes.append(at)
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert all(s == 256 or s & (s - 1) == 0 for s in sizes) and sum(sizes) == sum(map(len, ids)) + len(ids[0])
    assert packing.pack_digests(docs.limit(0)).count() == 0


def test_copies_are_neighbours(spark):
    ts = texts()[:40]
    docs = spark.createDataFrame([(i, ts[i % 40]) for i in range(80)], "doc_id long, text string")
    place = {r.doc_id: r.begin for r in packing.pack(docs, context=1 << 20).selectExpr("doc_id", "offset as begin").collect()}
    order = sorted(place, key=place.get)
    at = {d: k for k, d in enumerate(order)}
    assert sum(abs(at[i] - at[i + 40]) <= 3 for i in range(40)) >= 30
