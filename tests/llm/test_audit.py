"""The audit of filters against sets of row numbers in plain Python."""

import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from siftspark.llm import audit
from siftspark.llm.common import Scratch

DOCS = "doc_id long, text string, source string, part string, uid int, fails string"
LABELS = "doc_id long, quality int, toxic int"


def fails(i, text, first):
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    out = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
    return set(out + "E" * (i is not None and i > first.get(text, i)))


def brute(rows, labels):
    texts = [(i, t or "", s or "") for i, t, s in rows]
    first = {}
    for i, t, _ in texts:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    failing = [fails(i, t, first) for i, t, _ in texts]
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    out = []
    for part in {s for *_, s in texts}:
        of = [k for k, x in enumerate(texts) if x[2] == part]
        removed = {}
        for order in permutations("ABCDE"):
            left = set(of)
            for step, f in enumerate(order):
                hit = {k for k in of if f in failing[k]}
                gone = hit & left
                left -= gone
                removed[order, f] = len(gone)
                lost = lambda ids: sum(texts[k][0] in ids for k in gone)  # noqa: E731, B023
                out.append([part, "".join(order), step + 1, len(left), len(gone), len(hit - gone), sum(failing[k] == {f} for k in of), lost(good), lost(toxic), f])
        shapley = {f: sum(n for (_, g), n in removed.items() if g == f) for f in "ABCDE"}
        out = [(*x[:9], shapley[x[9]]) if isinstance(x, list) else x for x in out]
    return Counter(out)


def some_rows():
    r = np.random.default_rng(4)
    make = lambda: " ".join(r.choice(["aa", "b", "cc", "D", "EE", "f#", "g", *[f"h{i}" for i in range(300)]], int(r.choice([3, 150, 400]))).tolist())
    texts = [make() for _ in range(25)] + [None, "", " \n\x0b\x0c", "\x1c\x85\xa0 x", "É$", "A" * 50 + "x" * 2450, "word " * 40_000]
    rows = [(int(r.integers(0, 60)), texts[r.integers(len(texts))], [None, "", "s", "hot", "hot", "hot"][r.integers(6)]) for _ in range(200)]
    return rows + rows[:9] + [(None, texts[0], "s"), (None, texts[0], "s"), (-5, texts[1], None)]


@pytest.mark.parametrize(("bits", "share", "together"), [(13, 10_000, 64), (2, 30, 2)])
def test_audit_equals_sets(spark, monkeypatch, bits, share, together):
    monkeypatch.setattr(audit, "RANGE_BITS", bits)
    monkeypatch.setattr(audit, "SHARE", share)
    monkeypatch.setattr(audit, "TOGETHER", together)
    rows = some_rows()
    labels = [(i, i % 2, None if i % 3 else 1) for i in range(0, 60)] + [(3, 0, 1), (4, 1, 0), (4, None, None), (None, 1, 1)]
    docs = spark.createDataFrame([(*x, "p", 1, "f") for x in rows], DOCS).repartition(3)
    got = audit.audit(docs, spark.createDataFrame(labels, LABELS), Scratch(spark))
    assert Counter(tuple(x) for x in got.collect()) == brute(rows, labels)


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], LABELS)
    assert audit.audit(spark.createDataFrame([], DOCS), empty, Scratch(spark)).count() == 0
    docs = spark.createDataFrame([(1, "a " * 150 + " ".join(f"w{i}" for i in range(200)), "s", "p", 1, "f")], DOCS)
    got = audit.audit(docs, empty, Scratch(spark)).collect()
    assert len(got) == 600 and all(x.kept == 1 and x.removed == x.redundant == x.shapley == 0 for x in got)


@pytest.mark.parametrize("together", [1, 3, 64])
def test_galloping(monkeypatch, together):
    monkeypatch.setattr(audit, "TOGETHER", together)
    r = np.random.default_rng(2)
    for _ in range(200):
        lists = [np.unique(r.integers(0, r.integers(1, 400), r.integers(0, 200))).astype(np.int32) for _ in range(4)]
        a, b = lists[:2]
        assert audit.places(a, b).tolist() == np.searchsorted(b, a).tolist()
        assert audit.without(a, b).tolist() == sorted({*a.tolist()} - {*b.tolist()})
        assert audit.union(lists).tolist() == sorted(set().union(*(x.tolist() for x in lists)))
    assert audit.union([]).tolist() == []
