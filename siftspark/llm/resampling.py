"""Importance resampling towards a target: scores by arrays, and ranks by a radix sort of many stable counting passes."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Scratch

#: Bits of a key that one counting pass sorts by: a pass has so many counters at most, for all rows.
DIGIT_BITS = 16
#: Rows of one block of the order are 2 to this power; a task counts, and numbers, the rows of a block and digit.
BLOCK_BITS = 16
#: Spans of more bytes are summed one by one.
LONG_SPAN = 64
_word = np.ones(256, bool)
_word[: 0x30] = _word[0x3A:0x61] = _word[0x7B:0x80] = False  # after A-Z are lower case
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_crc = _crc_table()


def crc32(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of many spans of one buffer: a byte of each at a time, the longest first."""
    out = np.zeros(len(start), np.uint32)
    for k in np.flatnonzero(length > LONG_SPAN):
        out[k] = zlib.crc32(raw[start[k] : start[k] + length[k]])
    short = np.flatnonzero(length <= LONG_SPAN)
    order = short[np.argsort(-length[short], kind="stable")]
    at, size = start[order], length[order]
    c = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k))
        c[:n] = _crc[(c[:n] ^ raw[at[:n] + k]) & 255] ^ (c[:n] >> 8)
    out[order] = ~c
    return out


def _runs(raw: np.ndarray, bounds: np.ndarray, longest: int, buckets: int, carried: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts side by side (bounds: their places): the text of each word, of each run of words, and the run's bucket. The first ``carried`` words only begin runs."""
    raw = _lower[raw]
    inside = _word[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    first = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
    last = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False)))
    size = last - first + 1
    to = np.cumsum(size + 1) - size - 1  # the words once more, with one space after each
    joined = np.full(int(to[-1] + size[-1] + 1) if len(to) else 0, 32, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = raw[inside]
    text = np.searchsorted(bounds, first, "right") - 1
    of, bucket = [], []
    for n in range(1, longest + 1):
        k = np.arange(max(0, carried - n + 1), len(first) - n + 1)
        k = k[text[k] == text[k + n - 1]]
        of.append(text[k])
        bucket.append(crc32(joined, to[k], to[k + n - 1] + size[k + n - 1] - to[k]) % buckets)
    return text[carried:], np.concatenate(of), np.concatenate(bucket).astype(np.int64)


def _features(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """_runs of all texts (null: none), about a mebibyte at a time; a longer text in stretches that end between words, the last words carried on."""
    a = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(a):
        return
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] else np.empty(0, np.uint8)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, "right")) - 1)
        p, end, before = int(at[i]), int(at[j]), np.empty(0, np.uint8)
        if end - p <= CHUNK_BYTES:
            text, of, bucket = _runs(data[p:end], at[i : j + 1] - p, longest, buckets)
            yield text + i, of + i, bucket
            i = j
            continue
        while p < end:
            q = min(p + CHUNK_BYTES, end)
            while q < end and _word[_lower[data[q - 1]]]:  # a word of any length stays whole
                step = data[q : min(q + CHUNK_BYTES, end)]
                gap = np.flatnonzero(~_word[_lower[step]])
                q += int(gap[0]) + 1 if len(gap) else len(step)
            raw = np.concatenate([before, data[p:q]])
            words = np.diff(np.concatenate([[0], _word[_lower[before]].astype(np.int8), [0]])) == 1
            text, of, bucket = _runs(raw, np.array([0, len(raw)]), longest, buckets, int(words.sum()))
            yield text + i, of + i, bucket
            p, before = q, _last_words(raw, longest - 1)
        i = j


def _last_words(raw: np.ndarray, n: int) -> np.ndarray:
    first = np.flatnonzero(np.diff(np.concatenate([[0], _word[_lower[raw]].astype(np.int8)])) == 1)
    return np.append(raw[first[-n] if len(first) >= n else 0 :], np.uint8(32)) if n and len(first) else np.empty(0, np.uint8)


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How often each bucket has a feature, over the whole column ``text``: sums of arrays in tasks, then over tasks; the driver gets one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, bucket in _features(b.column(0), longest, buckets):
                n += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64())], ["bucket", "n"])

    found = texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target than in the source, one added to each count."""
    of_source, of_target = float(source.sum()) + len(source), float(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((t + 1.0) * of_source / ((s + 1.0) * of_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """doc_id, words, n_features and weight (the floored mean gain of the features; none: 0) of each row."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.num_rows
            words, n, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows)
            for text, of, bucket in _features(b.column(1), longest, buckets):
                words += np.bincount(text, minlength=rows)
                n += np.bincount(of, minlength=rows)
                total += np.bincount(of, weights=gain[bucket], minlength=rows)  # whole numbers below 2**53
            mean = total.astype(np.int64) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(n), pa.array(mean)], ["doc_id", "words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, words long, n_features long, weight long")


def radix_ranked(rows: DataFrame, keys: list[str], scratch: Scratch, place: str = "place", name: str = "radix") -> DataFrame:
    """Adds each row's place (from 0) in the order of whole, non-negative keys: the first is the foremost.

    Least significant digit first, one stable counting pass for each digit. Rows lie in blocks of
    the present order. A pass counts rows by block and digit; prefix sums over digits, and over the
    blocks of a digit, say where the rows of a block with a digit start; a row's number among them
    gives its destination, and the destination its next block. So a pass is one shuffle by block
    and digit, no task holds more than a block however the keys are spread, and a digit that all
    rows share costs no pass. Rows with equal keys get neighbouring places. Null keys must be mapped by the caller. Each pass is written to the shared folder.
    """
    ask = [F.max(k).alias(k) for k in keys]
    x = scratch.save(rows.withColumn("_at", F.monotonically_increasing_id()), f"{name}-0")
    most, step = x.agg(*ask).first(), 0
    digits = [(k, shift) for k in reversed(keys) for shift in range(0, max(0, most[k] or 0).bit_length(), DIGIT_BITS)] or [(keys[-1], 0)]
    for key, shift in digits:
        digit = F.shiftright(F.col(key), shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).cast("int")
        x = x.withColumn("_block", F.shiftright("_at", BLOCK_BITS)).withColumn("_digit", digit)
        counts = x.groupBy("_block", "_digit").agg(F.count("*").alias("n"))
        digits_before = counts.groupBy("_digit").agg(F.sum("n").alias("n"))  # at most 2**DIGIT_BITS rows
        digits_before = digits_before.select(F.col("_digit").alias("_d"), (F.sum("n").over(Window.orderBy("_digit")) - F.col("n")).alias("_low"))
        inside = F.sum("n").over(Window.partitionBy("_digit").orderBy("_block")) - F.col("n")
        start = counts.withColumn("_in", inside).join(F.broadcast(digits_before), F.col("_digit") == F.col("_d"))
        start = start.select(F.col("_block").alias("_b"), F.col("_digit").alias("_d"), (F.col("_low") + F.col("_in")).alias("_start"))
        nth = F.row_number().over(Window.partitionBy("_block", "_digit").orderBy("_at"))
        moved = x.withColumn("_nth", nth).join(start, (F.col("_block") == F.col("_b")) & (F.col("_digit") == F.col("_d")))
        moved = moved.select(*rows.columns, (F.col("_start") + F.col("_nth") - 1).cast("long").alias("_at"))
        x, step = scratch.save(moved, f"{name}-{step + 1}"), step + 1
        scratch.drop(f"{name}-{step - 1}")
    return x.withColumnRenamed("_at", place)


def resample(docs: DataFrame, target: DataFrame, scratch: Scratch, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: str = "2024") -> DataFrame:
    """Draws documents that resemble the target texts, without replacement, by Gumbel noise on their weights.

    Returns doc_id, n_features, weight, score for every row of docs, and rank (from 1) for the
    drawn: of the N rows with at least ``least_words`` words, percent * N / 100 (floored) highest
    scores, ties to the smaller doc_id (null first). Null and empty texts have no features and
    weight 0. Repeated rows count each time; rows of one doc_id draw the same noise. An empty
    target or no documents: the gains of zero counts, no rows. Other columns are ignored.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    w = weights(docs, gain, longest)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    w = scratch.save(w.withColumn("score", (F.col("weight") + noise).cast("long")), "resample-scores")
    fit = w.where(F.col("words") >= least_words)
    s = fit.agg(F.count("*").alias("n"), F.max("score").alias("high"), F.min("doc_id").alias("low")).first()
    out = ["doc_id", "n_features", "weight", "score"]
    rest = w.where(F.col("words") < least_words).select(*out, F.lit(None).cast("long").alias("rank"))
    if not s.n:
        return rest
    key = fit.select(*out, (F.lit(s.high) - F.col("score")).alias("_falling"), F.coalesce(F.col("doc_id").cast("decimal(20,0)") - F.lit(s.low or 0) + 1, F.lit(0)).alias("_id"))
    wide = key.agg(F.max("_id")).first()[0] >= 1 << 62  # ids too far apart for one key: two halves of them
    if wide:
        key = key.withColumn("_high", F.floor(F.col("_id") / (1 << 32)).cast("long")).withColumn("_id", F.pmod("_id", F.lit(1 << 32)))
    key = key.withColumn("_id", F.col("_id").cast("long"))
    placed = radix_ranked(key, ["_falling", *(["_high"] if wide else []), "_id", "n_features"], scratch)
    drawn = s.n * percent // 100
    return placed.select(*out, F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")).unionByName(rest)
