"""Importance resampling: features, gains, the radix sort and the draw against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftspark.llm import resampling
from siftspark.llm.common import Scratch

DOCS = "doc_id long, text string, score string, rank int, _at int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def buckets_of(text, longest, buckets):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, longest=1, buckets=10_000, least=20, percent=10):
    f = [buckets_of(t, longest, buckets) for _, t in rows]
    s, t = Counter(b for x in f for b in x), Counter(b for x in target for b in buckets_of(x, longest, buckets))
    total_s, total_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * total_s / ((s[b] + 1) * total_t)))
    out = []
    for (i, text), x in zip(rows, f, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, x)) // len(x) if x else 0
        out.append((i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= least))
    fit = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[1]))
    drawn = len(fit) * percent // 100
    return Counter([(*x[:4], k + 1 if k < drawn else None) for k, x in enumerate(fit)] + [(*x[:4], None) for x in out if not x[4]])


def some_rows(n=300):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(80)] + ["Éa", "漢字", "AbC", "x" * 90, "don't", "a\x00b", "ß"]
    rows = [(r.randrange(-50, 200), r.choice([" ", "\n", "\x01, "]).join(r.choices(vocabulary, k=r.randrange(60)))) for _ in range(n)]
    rows += [(None, "one two " * 30), (None, None), (7, None), (8, ""), (9, " \n"), (2**62, "big id " * 12), (-(2**62), "small id " * 12)]
    return rows + rows[:20] + [(10**6, "W1 " * 50_000)]


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (3, 257)])
def test_resampling_equals_plain_python(spark, longest, buckets):
    rows, target = some_rows(), ["w1 w2 w3 " * 9, None, "", "Éa 漢字"]
    docs = spark.createDataFrame([(*x, "s", 1, 2) for x in rows], DOCS)
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), Scratch(spark), longest=longest, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, target, longest, buckets)


def test_resampling_of_nothing(spark):
    empty, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", "s", 1, 1)], DOCS)
    assert resampling.resample(empty, some, Scratch(spark)).count() == 0
    assert [tuple(r) for r in resampling.resample(some, empty, Scratch(spark), least_words=1, percent=100).select("n_features", "rank").collect()] == [(2, 1)]
    assert resampling.resample(some, empty, Scratch(spark)).first()["rank"] is None


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_features_in_stretches(monkeypatch, longest):
    monkeypatch.setattr(resampling, "CHUNK_BYTES", 64)
    texts = [t for _, t in some_rows(40)] + ["y" * 500 + " z", " ".join(f"q{i}" for i in range(300)), "."]
    seen = [[] for _ in texts]
    n = np.zeros(len(texts), int)
    for text, of, bucket in resampling._features(pa.array(texts), longest, 1 << 31):
        n += np.bincount(text, minlength=len(texts))
        for i, b in zip(of.tolist(), bucket.tolist(), strict=True):
            seen[i].append(b)
    assert [sorted(x) for x in seen] == [sorted(buckets_of(t, longest, 1 << 31)) for t in texts]
    assert n.tolist() == [len(words_of(t)) for t in texts]


def test_crc_of_spans():
    r = np.random.default_rng(1)
    raw = r.integers(0, 256, 3000).astype(np.uint8)
    start = r.integers(0, 2000, 200)
    length = r.integers(0, 300, 200)
    assert resampling.crc32(raw, start, length).tolist() == [zlib.crc32(raw[a : a + n]) for a, n in zip(start, length, strict=True)]


def test_radix_places(spark, monkeypatch):
    monkeypatch.setattr(resampling, "DIGIT_BITS", 4)
    monkeypatch.setattr(resampling, "BLOCK_BITS", 3)
    r = random.Random(9)
    rows = [(r.choice([5, 5, 5, r.randrange(2000)]), r.randrange(100), i) for i in range(500)]
    got = resampling.radix_ranked(spark.createDataFrame(rows, "a long, b long, i long").repartition(7), ["a", "b"], Scratch(spark)).orderBy("place").collect()
    assert [x.place for x in got] == list(range(500)) and [(x.a, x.b) for x in got] == sorted((a, b) for a, b, _ in rows)
    same = resampling.radix_ranked(spark.range(40).select(F.lit(0).cast("long").alias("a")), ["a"], Scratch(spark))
    assert sorted(x.place for x in same.collect()) == list(range(40))
