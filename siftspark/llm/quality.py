"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import batch_of
from .lines import SPACE, TABLE
from .repeats import _mix, _powers

#: Word vectors: hashed words, components, non-zero components of an index vector.
WORDS, SIZE, NONZERO = 1 << 14, 32, 4
#: Shapes (a word with its letters and digits reduced to classes, the first SHAPE_PARTS of them) have index vectors of their own.
SHAPES, SHAPE_SIZE, SHAPE_PARTS = 512, 32, 8
ROW_BLOCK = 256
#: UTF-8 bytes looked at together; the arrays made of them take some hundred times as much.
CHUNK_BYTES = 1 << 18
#: Bytes of words at their ends that don't count, and classes of bytes: letters, capitals, digits, all others their own.
_punctuation = np.isin(np.arange(256), np.frombuffer(b".,;:!?", np.uint8))
_classes = np.arange(256, dtype=np.uint8)
_classes[97:123] = _classes[128:] = ord("a")
_classes[65:91] = ord("A")
_classes[48:58] = ord("0")


def index_vectors(rows: int, size: int, seed: int) -> np.ndarray:
    """Sparse random vectors of -1, 0 and 1, the same on every machine: (rows, size)."""
    r = np.random.default_rng(seed)
    out = np.zeros((rows, size), np.float32)
    at = np.argsort(r.random((rows, size)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, r.choice(np.array([-1, 1], np.float32), (rows, NONZERO)), axis=1)
    return out


def coded(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of a buffer, between ASCII white space: where it starts, the hash of its bytes, its hashed word and its hashed shape.

    The hashed word is of its lower case (ASCII and Latin-1) without punctuation at its ends.
    """
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate([[True], SPACE[raw], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    shape = _classes[raw]
    low = np.frombuffer(data.lower(), np.uint8).copy()
    high = np.flatnonzero(raw[:-1] == 0xC3) + 1
    high = high[(raw[high] < 0x9F) & (raw[high] != 0x97)]
    low[high] += 0x20
    shape[high] = shape[high - 1] = ord("A")
    power, inverse = _powers(len(raw))
    zero, at = np.zeros(1, np.uint64), np.arange(len(raw))
    sums = np.concatenate([zero, np.cumsum(TABLE[low] * power[: len(raw)])])
    whole = _mix((sums[end] - sums[start]) * inverse[start])
    solid = ~_punctuation[raw]
    last = np.maximum.accumulate(np.where(solid, at, -1))[end - 1] + 1
    first = np.minimum.accumulate(np.where(solid, at, len(raw))[::-1])[::-1][start]
    bare = last > first
    first, last = np.where(bare, first, start), np.where(bare, last, start)
    word = _mix((sums[last] - sums[first]) * inverse[first]) >> np.uint64(64 - 14)
    new = np.append(True, shape[1:] != shape[:-1]) | ~np.isin(shape, np.frombuffer(b"aA0", np.uint8))
    parts = np.concatenate([[0], np.cumsum(new)])
    first = parts[start]
    last = np.minimum(parts[end], first + SHAPE_PARTS)
    sums = np.concatenate([zero, np.cumsum(TABLE[shape[new]] * power[: int(parts[-1])])])
    form = _mix((sums[last] - sums[first]) * inverse[first]) % np.uint64(SHAPES - 1) + np.uint64(1)
    return start, whole, word.astype(np.int32), form.astype(np.int32)


def stretches(texts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """Texts put together: (their numbers, where each starts in the buffer, buffer). Texts over CHUNK_BYTES come in stretches, alone but the last, that end at white space, if there is any."""
    rows, starts, held, n = [], [], [], 0
    for row, raw in texts:
        if held and n + len(raw) > CHUNK_BYTES:
            yield np.array(rows), np.array(starts), b"\n".join(held)
            rows, starts, held, n = [], [], [], 0
        while len(raw) > CHUNK_BYTES:
            cut = max(raw.rfind(b" ", 0, CHUNK_BYTES), raw.rfind(b"\n", 0, CHUNK_BYTES)) + 1 or len(raw)
            yield np.array([row]), np.zeros(1, np.int64), raw[:cut]
            raw = raw[cut:]
        rows.append(row)
        starts.append(n)
        held.append(raw)
        n += len(raw) + 1
    if held:
        yield np.array(rows), np.array(starts), b"\n".join(held)


def _bytes(values: pa.Array) -> Iterator[tuple[int, bytes]]:
    return ((k, v.as_py() or b"") for k, v in enumerate(values))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums of neighbours' index vectors for each hashed word, in blocks of ROW_BLOCK rows."""
    index = index_vectors(WORDS, SIZE, 1)
    place = np.argsort(index == 0, axis=1, kind="stable")[:, :NONZERO]
    sign = np.take_along_axis(index, place, axis=1).astype(np.float64)
    total = np.zeros(WORDS * SIZE)
    for b in batches:
        for _, starts, data in stretches(_bytes(b.column(0))):
            at, _, word, _ = coded(data)
            text = np.searchsorted(starts, at, side="right")
            pair = np.flatnonzero(text[1:] == text[:-1])
            left, right = word[pair], word[pair + 1]
            for x, y in ((left, right), (right, left)):
                flat = (x.astype(np.int64) * SIZE)[:, None] + place[y]
                total += np.bincount(flat.ravel(), sign[y].ravel(), WORDS * SIZE)
    schema = pa.schema([("block", pa.int32()), ("sums", pa.binary())])
    rows = total.astype("<f4").reshape(WORDS // ROW_BLOCK, -1)
    yield batch_of(schema, np.arange(len(rows)), [r.tobytes() for r in rows])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(raw, "<f4").astype(np.float64)
            sums[k] = sums[k] + x if k in sums else x
    if sums:
        schema = pa.schema([("block", pa.int32()), ("sums", pa.binary())])
        yield batch_of(schema, list(sums), [v.astype("<f4").tobytes() for v in sums.values()])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Random indexing over all documents: for each of WORDS hashed words the direction of the sum of its neighbours' index vectors.

    The result has a fixed size; only it reaches the driver. Each task adds up its own sums, which
    are then added by block of words, streaming.
    """
    parts = docs.select(F.col("text").cast("string").cast("binary")).mapInArrow(_contexts, "block int, sums binary")
    out = np.zeros((WORDS // ROW_BLOCK, ROW_BLOCK * SIZE), np.float32)
    for r in parts.repartition("block").mapInArrow(_summed, "block int, sums binary").collect():
        out[r.block] += np.frombuffer(bytes(r.sums), "<f4")
    out = out.reshape(WORDS, SIZE)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def features(texts: pa.Array, vectors: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Each document's pooled vectors: the means of its words' vectors and of its shapes' vectors, shares of repeats and of distinct words, and length."""
    m = len(texts)
    n, again, distinct = np.zeros(m), np.zeros(m), np.zeros(m)
    words, forms = np.zeros((m, SIZE), np.float32), np.zeros((m, SHAPE_SIZE), np.float32)
    long, seen = -1, np.empty(0, bool)  # a text that comes in stretches, and its words so far
    for rows, starts, data in stretches(_bytes(texts)):
        at, whole, word, form = coded(data)
        if not len(at):
            continue
        text = np.searchsorted(starts, at, side="right") - 1
        repeat = np.append(False, (whole[1:] == whole[:-1]) & (text[1:] == text[:-1]))
        form[repeat] = 0
        first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        row = rows[text[first]]
        n[row] += np.diff(np.append(first, len(text)))
        again[row] += np.add.reduceat(repeat.astype(np.float64), first)
        words[row] += np.add.reduceat(vectors[word], first, axis=0)
        forms[row] += np.add.reduceat(shapes[form], first, axis=0)
        pair = np.unique((rows[text].astype(np.int64) << 14) | word)
        if len(rows) == 1 or rows[0] == long:
            if rows[0] != long:
                long, seen = rows[0], np.zeros(WORDS, bool)
            own = pair >> 14 == long
            seen[pair[own] & (WORDS - 1)] = True
            distinct[long] = seen.sum()
            pair = pair[~own]
        distinct += np.bincount(pair >> 14, minlength=m)
    some = np.maximum(n, 1)[:, None]
    tail = np.stack([again / some[:, 0], distinct / some[:, 0], np.log1p(n) / 10, n == 0], axis=1)
    return np.concatenate([words / some, forms / some, tail], axis=1).astype(np.float32)


@dataclass
class Network:
    """Two layers and a temperature: probability = sigmoid((w2 . relu(w1 (x - mean) / scale)) / temperature)."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 3) -> Network:
    """Adam on the cross-entropy of four fifths of the rows; the temperature on the rest. Without both classes the score is the smoothed share of ones."""
    r = np.random.default_rng(seed)
    d = x.shape[1] if x.ndim == 2 and len(x) else SIZE + SHAPE_SIZE + 4
    base = (float(y.sum()) + 1) / (len(y) + 2)
    net = Network(np.zeros(d, np.float32), np.ones(d, np.float32), np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(base / (1 - base))))
    if len(np.unique(y)) < 2:
        return net
    net.mean, net.scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - net.mean) / net.scale, -8, 8).astype(np.float64)
    order = r.permutation(len(z))
    held, train = (order[: len(z) // 5], order[len(z) // 5 :]) if len(z) >= 50 else (order, order)
    p = [r.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), r.standard_normal(hidden) * np.sqrt(1 / hidden), np.array(net.b2)]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        for rows in np.array_split(r.permutation(train), max(1, len(train) // 256)):
            a = z[rows] @ p[0] + p[1]
            h = np.maximum(a, 0)
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(g, p[2]) * (a > 0)
            grads = [z[rows].T @ back + 1e-4 * p[0], back.sum(0), h.T @ g + 1e-4 * p[2], g.sum()]
            step += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3])
    raw, t = net.logits(x[held]), np.geomspace(0.25, 8, 61)
    loss = [np.mean(np.logaddexp(0, raw / s) - y[held] * raw / s) for s in t]
    net.temperature = float(t[int(np.argmin(loss))])
    return net


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def model(docs: DataFrame, labels: DataFrame, most: int = 20_000):
    """Learns from docs and labels (doc_id, quality): returns a function from a text column to a column of scores, 0 to 1.

    Word vectors come from all documents. Only labels with crc32(doc_id as text) mod 4 other than 2
    are used, and of those the first most by the md5 of doc_id: a sample of fixed bound, small
    enough to be sent to all tasks. Scores are computed beside the rows: texts don't come back from
    Python.
    """
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))  # of fixed size
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("_l_doc")).agg(F.max("quality").alias("_y"))
    known = known.where(~held_out(F.col("_l_doc"))).orderBy(F.md5(F.col("_l_doc").cast("string").cast("binary")), "_l_doc").limit(most)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = index_vectors(SHAPES, SHAPE_SIZE, 2)
        for b in batches:
            f = pa.array([x.tobytes() for x in features(b.column(2), vectors.value, shapes)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], f], names=["doc", "y", "f"])

    some = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").cast("binary").alias("_text"))
    some = some.join(F.broadcast(known), F.col("_doc") == F.col("_l_doc")).select("_doc", F.col("_y").cast("long"), "_text")
    got = some.mapInArrow(pooled, "doc long, y long, f binary").orderBy("doc", "f").limit(most).collect()
    net = fit(np.array([np.frombuffer(bytes(r.f), np.float32) for r in got], np.float32), np.array([r.y for r in got], np.float64))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(net.score(features(texts, vectors.value, index_vectors(SHAPES, SHAPE_SIZE, 2))), pa.float64())

    return lambda text: score(text.cast("string").cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), sample: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """Quality of every whole text: the kept columns, held_out, score and predicted (1 from threshold on).

    A score depends on the text alone. Null and empty texts get the score of a text without words;
    without usable labels all get the same score; repeated rows are scored each; a null doc_id is
    not held out; no documents, no rows. A kept column may not have the name of a new one.
    """
    if clash := {"held_out", "score", "predicted"}.intersection(keep):
        raise ValueError(f"columns to keep have names of new ones: {sorted(clash)}")
    x = docs.select(*keep, held_out(F.col("doc_id")).alias("held_out"), model(docs, labels, sample)(F.col("text")).alias("score"))
    return x.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """The documents whose score is threshold or more, with their columns as they were, whatever their names."""
    return docs.where(model(docs, labels, sample)(F.col("text")) >= threshold)
