"""Features of the classifier against plain loops, and its results on odd rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from siftspark.llm import quality

from .test_operators import ODD, docs, empty

VECTORS = np.random.default_rng(1).standard_normal((quality.WORDS, quality.SIZE)).astype(np.float32)
SHAPE_VECTORS = quality.index_vectors(quality.SHAPES, quality.SHAPE_SIZE, 2)


def lowered(word: str) -> str:
    return "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" and c != "×" else c for c in word)


def plain_word(word: str) -> str:
    return lowered(word).strip(".,;:!?") or lowered(word)


def plain_shape(word: str) -> str:
    classes = "".join("A" if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else "0" if c in "0123456789" else "a" if not c.isascii() or c.islower() else c for c in word)
    return re.sub(r"([aA0])\1+", r"\1", classes)[: quality.SHAPE_PARTS]


def test_words_and_shapes_are_classes_of_words():
    r = random.Random(3)
    words = ["".join(r.choices("aBé É1.,;:-ÀxY!?漢ö".replace(" ", ""), k=r.randrange(1, 9))) for _ in range(4000)]
    _, _, word, shape = quality.coded(" ".join(words).encode())
    for codes, key, most in ((word, plain_word, quality.WORDS), (shape, plain_shape, quality.SHAPES)):
        known: dict = {}
        for w, c in zip(words, codes.tolist(), strict=True):
            assert known.setdefault(key(w), c) == c, w
            assert 0 <= c < most
        assert len(set(known.values())) > 0.5 * min(len(known), most / 2)


def brute(text: str) -> np.ndarray:
    words = text.split()
    _, _, code, shape = quality.coded(text.encode())
    shape = [0 if k and words[k].lower() == words[k - 1].lower() else s for k, s in enumerate(shape)]
    n = max(1, len(words))
    mean = lambda m, at, d: np.sum([m[i] for i in at], axis=0) / n if words else np.zeros(d)
    tail = [shape.count(0) / n, len(set(code.tolist())) / n, np.log1p(len(words)) / 10, float(not words)]
    return np.concatenate([mean(VECTORS, code, quality.SIZE), mean(SHAPE_VECTORS, shape, quality.SHAPE_SIZE), tail])


@pytest.mark.parametrize("stretch", [40, 1 << 20])
def test_features_equal_plain_loops(monkeypatch, stretch):
    monkeypatch.setattr(quality, "CHUNK_BYTES", stretch)
    texts = ["", "One two two Two three.", "x", "a b c d e f g h", "the the the end, END", " \n "]
    got = quality.features(pa.array([t.encode() for t in texts]), VECTORS, SHAPE_VECTORS)
    assert np.allclose(got, np.stack([brute(t) for t in texts]), atol=1e-5)


def test_long_texts_come_in_stretches(monkeypatch):
    text = " ".join(f"w{i % 50}" for i in range(2000))
    whole = quality.features(pa.array([b"a b", text.encode(), None]), VECTORS, SHAPE_VECTORS)
    monkeypatch.setattr(quality, "CHUNK_BYTES", 300)
    assert np.allclose(whole, quality.features(pa.array([b"a b", text.encode(), None]), VECTORS, SHAPE_VECTORS), atol=1e-3)


def test_odd_rows_ties_and_clashing_names(spark):
    labels = spark.createDataFrame([(3, None), (4, 1), (4, 0), (None, 1)], "doc_id long, quality int")
    out = quality.classify(docs(spark), labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (4, 5)}) == 1 and len({r.score for r in out if r.doc_id in (1, 2, 3)}) == 1
    assert quality.classify(empty(spark), labels).count() == 0
    named = docs(spark).withColumnsRenamed({"source": "score", "size": "predicted", "key": "held_out"})
    with pytest.raises(ValueError, match="score"):
        quality.classify(named, labels, ("doc_id", "score"))
    kept = quality.good(named, labels, threshold=0.0)
    assert kept.columns == named.columns and kept.count() == len(ODD)
    assert quality.good(docs(spark), labels, threshold=1.1).count() == 0
