"""Removal of long byte strings that repeat: prefix doubling over content-anchored blocks of positions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import batch_of
from .common import Scratch

#: Bytes of the first prefix, and of a block of positions in the last but one round.
GRAM, BLOCK = 32, 32
#: UTF-8 bytes worked on at once; longer documents are cut into stretches that overlap.
STRETCH = 1 << 20
#: Periods up to this are resolved inside the document.
PERIOD = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _cache or max(_cache) < n:
        _cache.clear()
        one = np.ones(1, np.uint64)
        _cache[n] = tuple(np.concatenate([one, np.cumprod(np.full(n, b, np.uint64))]) for b in (_ODD, _ODD_INV))
    return _cache[max(_cache)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Ranks:
    """128-bit fingerprints of any byte ranges of a buffer; equal strings have equal ones wherever they stand.

    They serve as ranks that need no exchange: sums of mixed 8-byte words times powers of an odd
    number, modulo 2^64, twice with different mixing.
    """

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data + b"\0" * 16, np.uint8)
        words = np.empty(len(data), np.uint64)
        for r in range(8):
            w = raw[r : r + (len(raw) - r) // 8 * 8].view("<u8")
            words[r::8] = w[: len(words[r::8])]
        power, self.inverse = _powers(len(data) + 8)
        zero = np.zeros(1, np.uint64)
        self.sums = [np.concatenate([zero, np.cumsum(_mix(words ^ np.uint64(salt)) * power[: len(words)])]) for salt in (0x1234567, 0xABCDEF0123)]

    def of(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the ranges [start, end), of 8 bytes at least."""
        return tuple(_mix((s[end - 7] - s[start]) * self.inverse[start]).view(np.int64) for s in self.sums)


def anchors(ranks: Ranks, n: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each start in a buffer of n bytes the place of the least 32-byte prefix inside the window that starts there.

    Returns runs of starts that share it: (first start, number of starts, place). Equal windows have
    it at the same place from their start, as it depends on their bytes alone (ties: the leftmost).
    """
    at = np.arange(n - GRAM + 1)
    h = ranks.of(at, at + GRAM)[0].view(np.uint64)
    v = (h & ~np.uint64(0xFFFFFFF)) | at.astype(np.uint64)
    wide, span = window - GRAM + 1, 1
    while span * 2 <= wide:
        v = np.minimum(v[: len(v) - span], v[span:])
        span *= 2
    rest = wide - span
    v = np.minimum(v[: len(v) - rest], v[rest:]) if rest else v
    place = (v & np.uint64(0xFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    return first, np.diff(np.append(first, len(place))), place[first]


def periodic(data: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Ranges [s, e) of windows that equal the window a period before, for periods up to PERIOD."""
    found = []
    for d in range(1, min(PERIOD, len(data) - window) + 1):
        bad = np.concatenate([[-1], np.flatnonzero(data[d:] != data[:-d]), [len(data) - d]])
        for g in np.flatnonzero(np.diff(bad) > window):
            found.append((int(bad[g]) + 1 + d, int(bad[g + 1]) + d - window + 1, d))
    return found


def _stretches(b: pa.RecordBatch, window: int, size: int) -> Iterator[tuple[list, bytes]]:
    """Stretches of documents put together: ([(row, start in document, start in buffer, bytes)], buffer)."""
    parts, held, n = [], [], 0
    for row, t in enumerate(b.column(b.schema.get_field_index("text"))):
        raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
        for s in range(0, max(1, len(raw) - window + 1), size):
            piece = raw[s : s + size + window - 1]
            if n and n + len(piece) > size:
                yield parts, b"".join(held)
                parts, held, n = [], [], 0
            parts.append((row, s, n, len(piece)))
            held.append(piece)
            n += len(piece)
    if parts:
        yield parts, b"".join(held)


def stretch_runs(parts: list, data: bytes, window: int) -> tuple[np.ndarray, ...]:
    """Runs of starts of a buffer that lie inside their document: (part, start, count, anchor - start, and the ranks of the anchor's prefix and of the whole run), and repeats (part, start, end) found by period."""
    n = len(data)
    if n < window:
        return (*[np.empty(0, np.int64)] * 7, [])
    ranks = Ranks(data)
    first, count, place = anchors(ranks, n, window)
    start = np.array([p[2] for p in parts])
    last = np.array([p[2] + p[3] - window for p in parts])  # the last start of each part
    fits = np.flatnonzero(last >= start)
    if not len(fits):
        return (*[np.empty(0, np.int64)] * 7, [])
    # cut runs at the parts' borders: those of each part that overlap its starts
    a = np.searchsorted(first, start[fits], side="right") - 1
    z = np.searchsorted(first, last[fits], side="right")
    part = np.repeat(fits, z - a)
    k = np.arange(len(part)) - np.repeat(np.cumsum(z - a) - (z - a), z - a) + np.repeat(a, z - a)
    lo = np.maximum(first[k], start[part])
    hi = np.minimum(first[k] + count[k] - 1, last[part])
    zones, keep = [], np.ones(len(part), bool)
    many = np.bincount(part, minlength=len(parts))
    raw = np.frombuffer(data, np.uint8)
    for p in np.flatnonzero(many * 24 > np.maximum(last - start + 1, 240)):
        for s, e, d in periodic(raw[start[p] : last[p] + window], window):
            zones.append((p, s - d, e + window - 1))
            keep &= ~((part == p) & (lo >= start[p] + s) & (hi < start[p] + e))
    part, lo, hi, place = part[keep], lo[keep], hi[keep], place[k[keep]]
    gram = ranks.of(place, place + GRAM)[0]
    whole = ranks.of(lo, hi + window)
    return part, lo - start[part], hi - lo + 1, place - lo, gram, *whole, zones


def _runs(window: int):
    fields = [("doc_id", pa.int64()), ("th", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("off", pa.int64()), ("gram", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th = b.column(0), b.column(1).to_numpy()
            for parts, data in _stretches(b, window, STRETCH):
                part, lo, n, off, gram, r1, r2, zones = stretch_runs(parts, data, window)
                row, base = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
                if len(part):
                    yield batch_of(schema, ids.take(pa.array(row[part])), th[row[part]], lo + base[part], n, off, gram, r1, r2)
                if zones:
                    z = np.array(sorted(set(zones)))
                    new = np.append(True, (z[1:, 0] != z[:-1, 0]) | (z[1:, 1] > z[:-1, 2]))  # ranges that touch become one
                    at = np.flatnonzero(new)
                    p, s, e = z[at, 0], z[at, 1], np.maximum.reduceat(z[:, 2], at)
                    zero = np.zeros(len(p), np.int64)
                    yield batch_of(schema, ids.take(pa.array(row[p])), th[row[p]], s + base[p], e - s - window + 1, zero - 1, zero, zero, zero)

    return run


def _blocks(window: int):
    """Blocks of BLOCK starts of the runs left, by their distance from the anchor: rank of the bytes common to the block's windows, rank of all its bytes, and the bytes besides the common ones."""
    names = ["doc_id", "th", "lo", "n", "t", "grid", "c1", "c2", "u1", "u2"]
    schema = pa.schema([(x, pa.int64()) for x in names] + [("left", pa.binary()), ("right", pa.binary())])
    common = window - BLOCK + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                doc, th, text, runs = (b.column(c)[row].as_py() for c in range(4))
                raw, runs = text.encode("utf-8", "surrogatepass"), np.array([(r["lo"], r["n"], r["off"]) for r in runs])
                runs = runs[np.argsort(runs[:, 0], kind="stable")]
                for _, some in _by(runs, runs[:, 0] // STRETCH):
                    s = int(some[0, 0])
                    data = raw[s : int((some[:, 0] + some[:, 1]).max()) + window]
                    lo, n, anchor = some[:, 0] - s, some[:, 1], some[:, 0] - s + some[:, 2]
                    g0, g1 = (anchor - lo - n + 1) // BLOCK, (anchor - lo) // BLOCK
                    k = np.repeat(np.arange(len(lo)), g1 - g0 + 1)
                    grid = np.arange(len(k)) - np.searchsorted(k, k) + g0[k]
                    core = anchor[k] - BLOCK * grid  # the start with distance BLOCK * grid
                    first, last = np.maximum(lo[k], core - BLOCK + 1), np.minimum(lo[k] + n[k] - 1, core)
                    ranks = Ranks(data)
                    c, u = ranks.of(core, core + common), ranks.of(first, last + window)
                    left = [data[i:j] for i, j in zip(first.tolist(), core.tolist(), strict=True)]
                    right = [data[i:j] for i, j in zip((core + common).tolist(), (last + window).tolist(), strict=True)]
                    m = len(k)
                    yield batch_of(schema, [doc] * m, np.full(m, th), first + s, last - first + 1, core - last, grid, *c, *u, left, right)

    return run


def _by(rows: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for part in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1):
        yield int(key[part[0]]), rows[part]


def _smaller(size: int):
    """Blocks of size starts out of BLOCK: the pair of the block's rank and the bytes at the offsets that its windows share gives the new rank."""
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "th", "lo", "n", "t", "grid", "c1", "c2")] + [("left", pa.binary()), ("right", pa.binary()), ("k1", pa.int64()), ("k2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, th, lo, n, t, grid, c1, c2, left, right in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in schema.names[:10]), strict=True):
                top = lo + n - 1 + t  # the start at t = 0
                base = len(left)
                for s in range(t // size, (t + n - 1) // size + 1):
                    t0, t1 = max(t, s * size), min(t + n - 1, s * size + size - 1)
                    more = BLOCK - 1 - (s * size + size - 1)
                    shared = left[base - s * size :] + b"|" + right[:more] if s else b"|" + right[:more]
                    h = hashlib.blake2b(b"%d,%d,%d,%d," % (c1, c2, grid, s * size) + shared, digest_size=16).digest()
                    k1, k2 = (int.from_bytes(x, "little", signed=True) for x in (h[:8], h[8:]))
                    rows.append((doc, th, top - t1, t1 - t0 + 1, t0, grid, c1, c2, left, right, k1, k2))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _cut(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, spans in zip(b.column(0), b.column(1), b.column(2), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for s in sorted((x["lo"], x["lo"] + x["n"] - 1 + window) for x in spans.as_py() or []):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                ends = [0, *(x for s in merged for x in s), len(raw)]
                kept = b"".join(raw[i:j] for i, j in zip(ends[::2], ends[1::2], strict=True))
                rows.append((doc.as_py(), len(raw), len(raw) - len(kept), len(merged), kept))
                if sum(len(r[4]) for r in rows[-64:]) > STRETCH or len(rows) >= 2048:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys stand in more than one row. Counts combine before the shuffle and the join can split a frequent key."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows")).where("_rows > 1").drop("_rows")
    return df.join(counts, keys, "left_semi")


def _copies(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds copies, the rows that share the keys, and one, true for the first of them, which stands for all in later rounds."""
    place = F.struct("doc_id", "th", "lo")
    same = df.groupBy(*keys).agg(F.count("*").alias("copies"), F.min(place).alias("_first"))
    return df.join(same, keys).withColumn("one", place.eqNullSafe(F.col("_first")))


def repeated_spans(docs: DataFrame, scratch: Scratch, window: int = 400) -> DataFrame:
    """(doc_id, th, lo, n): runs of n starts at byte lo whose strings of window bytes also start elsewhere.

    Starts of all positions are handled as blocks. Round 0 ranks a prefix of 32 bytes, the least one
    in the window by hash, which equal windows have at the same place; starts around a unique one
    are dropped. Runs of starts whose bytes all repeat are done. The others are cut into blocks of
    32, then 4, then 1 starts; the bytes that a block's windows share grow to 369, 397 and 400, and
    each round ranks the pair of the rank so far and the bytes at the new offsets and drops what is
    unique, until the length is window. Repeats at a short period inside a document are read off
    directly; one period of them stays in the rounds for other documents, and so does one of each
    class of runs or blocks that repeat as a whole. th is the text's hash.
    """
    d = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.col("text").cast("string"))
    kind = ", ".join(f"{x} long" for x in ("doc_id", "th", "lo", "n", "off", "gram", "r1", "r2"))
    runs = scratch.save(d.mapInArrow(_runs(window), kind), "rep-runs")
    span = ["doc_id", "th", "lo", "n"]
    done = [runs.where("off < 0").select(span)]
    active = scratch.save(_repeated(runs.where("off >= 0"), ["gram"]), "rep-active")
    active = scratch.save(_copies(active, ["r1", "r2", "off", "n"]).select(*span, "off", "copies", "one"), "rep-whole")
    done.append(active.where("copies > 1").select(span))
    edge = active.where("one").groupBy(F.col("doc_id").alias("e_doc"), F.col("th").alias("e_th")).agg(F.collect_list(F.struct("lo", "n", "off")).alias("runs"))
    texts = d.join(edge, F.col("doc_id").eqNullSafe(F.col("e_doc")) & (F.col("th") == F.col("e_th"))).select("doc_id", "th", "text", "runs")
    kind = ", ".join(f"{x} long" for x in (*span, "t", "grid", "c1", "c2", "u1", "u2"))
    blocks = scratch.save(texts.mapInArrow(_blocks(window), f"{kind}, left binary, right binary"), "rep-blocks")
    blocks = scratch.save(_repeated(blocks, ["grid", "c1", "c2"]), "rep-32")
    whole = _copies(blocks, ["grid", "t", "n", "u1", "u2"])
    blocks = scratch.save(whole.select(*span, "t", "grid", "c1", "c2", "left", "right", "copies", "one"), "rep-32-whole")
    done.append(blocks.where("copies > 1").select(span))
    rest = blocks.where("one").drop("copies", "one")
    kind = ", ".join(f"{x} long" for x in (*span, "t", "grid", "c1", "c2")) + ", left binary, right binary, k1 long, k2 long"
    for size in (4, 1):
        rest = scratch.save(rest.mapInArrow(_smaller(size), kind), f"rep-{size}-all")
        rest = scratch.save(_repeated(rest, ["k1", "k2"]).drop("k1", "k2"), f"rep-{size}")
    done.append(rest.select(span))
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def cut_repeats(docs: DataFrame, scratch: Scratch, window: int = 400) -> DataFrame:
    """Documents without bytes covered by a string of window bytes that also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans and kept (the bytes that remain, joined). Judged on
    the input as a whole, the same document included; matches stay inside documents; null counts
    as empty; texts under window bytes lose nothing; repeated rows are copies of each other; rows
    of one doc_id are told apart by their texts' hashes; other columns are ignored.
    """
    spans = repeated_spans(docs, scratch, window).groupBy(F.col("doc_id").alias("s_doc"), F.col("th").alias("s_th"))
    spans = spans.agg(F.collect_set(F.struct("lo", "n")).alias("spans"))
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("th"))
    d = d.join(spans, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("th") == F.col("s_th")), "left").select("doc_id", "text", "spans")
    return d.mapInArrow(_cut(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
