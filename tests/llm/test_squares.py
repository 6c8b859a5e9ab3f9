"""Online packing: the choice of levels against plain loops, whole packings against the vocabulary's own library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftspark.llm import squares

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, start string, sequence_id int"


def test_levels_choose_the_least_sum():
    r, limit = random.Random(2), 24
    levels, counts = squares.Levels(limit), [0] * (limit + 1)
    for n in range(3000):
        size = r.choice([3, 5, 7, 11, 13, 23])

        def after(h):
            c = counts[:]
            c[h] -= h > 0
            c[h + size] += 1
            return sum(x * x for x in c[1:limit])

        best = min(after(h) for h in range(limit - size + 1) if not h or counts[h])
        full = levels.put(size, (n, 0, np.zeros(size, "<u4")))
        now = [len(w) for w in levels.open] + [0]
        assert sum(x * x for x in now[1:limit]) == best and (full is None or sum(len(x[2]) for x in full) == limit)
        counts = now
    assert levels.count == sum(counts) == len(list(levels.drain())) and not levels.count


@pytest.mark.parametrize("sizes", [[], [5], [9, 9, 9, 8, 8, 3, 1], [1] * 40, [10] * 7])
def test_settling_fills_all_but_the_last(sizes):
    limit = 10
    windows = [(n, [((k, 0), 0, np.arange(n - n // 2)), ((k, 1), 0, np.arange(n // 2))] if n > 1 else [((k, 0), 0, np.arange(1))]) for k, n in enumerate(sorted(sizes, reverse=True))]
    out = list(squares._settled(windows, limit))
    assert all(level == sum(len(x[2]) for x in p) for level, p in out) and all(level == limit for level, _ in out[:-1])
    assert sum(level for level, _ in out) == sum(sizes)


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1337, 2047])
def test_powers(n):
    parts = [((0, n), 0, np.arange(n // 3)), ((1, n), 5, np.arange(n - n // 3))]
    lengths = [sum(len(x[2]) for x in p) for p in squares._whole_powers([p for p in parts if len(p[2])])]
    assert sum(lengths) == n and all(x & (x - 1) == 0 for x in lengths) and lengths == sorted(set(lengths), reverse=True)


def check(rows, texts, limit):
    """Every id of every row in one piece; sequences gapless, none longer than limit. Returns the share of padding and how many rows are cut that fit."""
    own = Tokenizer.from_file(VOCABULARY)
    places, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    padding = 0
    for p in places.values():
        p.sort()
        size = sum(n for _, n in p)
        assert [a for a, _ in p] == np.cumsum([0, *[n for _, n in p][:-1]]).tolist() and size <= limit
        padding += 0 if size & (size - 1) == 0 else limit - size
    want = defaultdict(list)
    for i, t in texts:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        want[i, len(ids)].append(np.array(ids, "<u4"))
    assert want.keys() == pieces.keys()
    cut = 0
    for key, found in pieces.items():
        some = want[key]
        found.sort(key=lambda x: x[0])
        assert sum(n for _, n, _ in found) == sum(map(len, some))
        if len(some) == 1:
            at = 0
            for start, n, crc in found:
                assert start == at and crc == zlib.crc32(some[0][at : at + n].tobytes())
                at += n
            cut += len(found) > 1 and at <= limit
    return padding / sum(map(len, (x for y in want.values() for x in y))), cut


@pytest.mark.parametrize("open_windows", [2048, 3])
def test_packing_of_given_documents(spark, monkeypatch, open_windows):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = squares.pack(docs, VOCABULARY).collect()
    padding, cut = check(rows, texts, 2048)
    assert padding == 0 and cut <= 0.4 * len(texts)


def test_packing_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t\n "), (4, "w1 " * 30_000), (5, "<|endoftext|> a"), (5, "don't stop"), (None, "naïve 漢字 ß \x01 \xa0x"), (7, "ab" * 3000), (8, "x" * 2), (8, "x" * 2)]
    docs = spark.createDataFrame([(*x, "s", 1) for x in rows], DOCS).repartition(2)
    got = squares.pack(docs, VOCABULARY).collect()
    assert check(got, rows, 2048)[0] == 0
    assert squares.pack(docs.limit(0), VOCABULARY).count() == 0


def test_encoder_equals_the_library(monkeypatch):
    e, own, r = squares.ByteEncoder(VOCABULARY), Tokenizer.from_file(VOCABULARY), random.Random(5)
    assert e.same
    letters = "ab'stmdrevl '\"-1 2Àß\n\té　漢,.\x01\x1c\x85\x7f÷\xa0Z\r²\U0001f600"
    for stretch in (1, 7, 1 << 19):
        monkeypatch.setattr(squares, "CHARS_AT_ONCE", stretch)
        for _ in range(300):
            t = "".join(r.choices(letters, k=r.randrange(60)))
            assert e.encode(t).tolist() == own.encode(t, add_special_tokens=False).ids, t
    assert e.encode("a <|endoftext|>b").tolist() == own.encode("a <|endoftext|>b", add_special_tokens=False).ids
    monkeypatch.setattr(e, "same", False)
    assert e.encode("a b").tolist() == own.encode("a b", add_special_tokens=False).ids


def test_few_open_windows(monkeypatch):
    """Windows are settled as soon as more are open than allowed, and go on being filled."""
    levels, limit = squares.Levels(16), 16
    for n in range(40):
        levels.put(9, (n, 0, np.zeros(9, "<u4")))
    out = list(squares._settled(list(levels.drain()), limit))
    assert sum(n for n, _ in out) == 360 and [n for n, _ in out] == [16] * 22 + [8]
