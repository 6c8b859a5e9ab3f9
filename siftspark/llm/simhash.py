"""SimHash near-dedup: 64-bit fingerprints of word shingles, joined by one-wildcard segment variants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import batch_of, grouped, in_pieces, small_pairs
from .common import Scratch, components

BITS, SEGMENT, EXACT = 64, 32, 32
SHINGLES_AT_ONCE = 1 << 16
#: Groups beyond this many fingerprints are dealt out as pairs of chunks of half the size.
GROUP_ROWS = 8192


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of a text: A-Z lower-cased, words between ASCII white space, shingles of width words.

    A bit is 1 if it is set in over half of the shingles' XXH64; repeats count. A text of fewer words
    is one shingle; one without words (null, empty, blank) has fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    count, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for a in range(0, n, SHINGLES_AT_ONCE):
        part = zip(starts[a : a + SHINGLES_AT_ONCE], ends[a : a + SHINGLES_AT_ONCE], strict=True)
        h = np.array([digest(line[i:j], seed) for i, j in part], dtype="<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64)
            yield batch_of(schema, b.column(0), fp.view(np.int64))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of each fingerprint: both halves as they are, and with each of their bits left out."""
    schema = pa.schema([("k", pa.int64()), ("fp", pa.int64())])
    masks = np.array([0xFFFFFFFF ^ (1 << i) for i in range(SEGMENT)] + [0xFFFFFFFF], np.uint64)
    which = np.arange(SEGMENT + 1, dtype=np.uint64) << np.uint64(SEGMENT)
    for b in batches:
        fps = b.column(0).to_numpy().view(np.uint64)
        for a in range(0, len(fps), 4096):
            f = fps[a : a + 4096]
            for side, half in enumerate((f & np.uint64(0xFFFFFFFF), f >> np.uint64(SEGMENT))):
                k = (half[:, None] & masks) | which | np.uint64(side << 40)
                yield batch_of(schema, k.ravel().view(np.int64), np.repeat(f, SEGMENT + 1).view(np.int64))


def _near(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= most


def forest(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links at up to most bits connect: a spanning forest, found breadth first."""
    rest, us, vs = np.unique(fp), [], []
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        f = queue.pop()
        hit = _near(rest, np.full(1, f, rest.dtype), most)
        if hit.any():
            us.append(np.full(int(hit.sum()), f, rest.dtype))
            vs.append(rest[hit])
            queue.extend(rest[hit])
            rest = rest[~hit]
    none = np.empty(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def _links(keys: list[str], most: int, limit: int):
    """Verified links inside groups of a shared signature; rows of groups over limit come back with link null."""
    schema = pa.schema([("k", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])
    make = lambda k, u, v: batch_of(schema, k, u, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, cols, starts in grouped(batches, keys, limit):
            k, fp = cols["k"], cols["fp"]
            if kind == "large":
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp), pa.nulls(len(k), pa.int64())], schema=schema)
                continue
            for i, j in small_pairs(starts, 32):
                near = _near(fp[i], fp[j], most) & (fp[i] != fp[j])
                if near.any():
                    yield from in_pieces(make, k[i][near], fp[i][near], fp[j][near])
            for g in np.flatnonzero(np.diff(starts) > 32):
                u, v = forest(fp[starts[g] : starts[g + 1]], most)
                if len(u):
                    yield from in_pieces(make, np.full(len(u), k[starts[g]]), u, v)

    return run


def near_links(fps: DataFrame, scratch: Scratch, most: int = 3, limit: int = GROUP_ROWS, name: str = "sh") -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) whose closure is that of all links at up to most (0 to 3) bits.

    Two halves share at most 3 differing bits, so one half differs in at most one: both then have
    the signature of that half with that bit left out. Groups of a signature are verified in
    blocks; a group gives a spanning forest of its links, not all pairs. Groups over limit are
    dealt out as all pairs of chunks of limit / 2 rows, so no task holds a whole one.
    """
    v = fps.select("fp").mapInArrow(_variants, "k long, fp long")
    found = v.repartition("k").sortWithinPartitions("k").mapInArrow(_links(["k"], most, limit), "k long, u long, v long")
    found = scratch.save(found, f"{name}/links")
    large = found.where("v is null").select("k", F.col("u").alias("fp"))
    if large.isEmpty():
        return found.select("u", "v")
    chunks = large.groupBy("k").agg(F.ceil(F.count("*") / (limit // 2)).cast("int").alias("n"))
    x = large.join(chunks, "k").withColumn("c", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    x = x.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    x = x.select("k", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "fp")
    more = x.repartition("k", "a", "b").sortWithinPartitions("k", "a", "b").mapInArrow(
        _links(["k", "a", "b"], most, 1 << 62), "k long, u long, v long"
    )
    return found.where("v is not null").select("u", "v").union(more.select("u", "v"))


def near_groups(docs: DataFrame, scratch: Scratch, width: int = 3, most: int = 3) -> DataFrame:
    """Groups of documents linked at up to most differing bits: doc_id, fp, component_id (smallest doc_id reachable).

    Equal fingerprints are one node, so copies cost no pairs. Null, empty and blank texts have
    fingerprint 0 and link like any other. Rows with one doc_id are kept as they are; a null doc_id
    gets the group of its text. Other columns are ignored.
    """
    d = scratch.save(fingerprints(docs, width), "sh-fps")
    nodes = scratch.save(d.groupBy("fp").agg(F.min("doc_id").alias("first")), "sh-nodes")
    cc = components(near_links(nodes, scratch, most), scratch, "sh-cc")
    to = nodes.join(cc, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("component", "fp"))
    ids = to.groupBy("root").agg(F.min("first").alias("component_id"))
    to = to.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return d.join(to, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, scratch: Scratch, width: int = 3, most: int = 3) -> DataFrame:
    """The documents that stay: of each group the one with the smallest doc_id, once if its row is repeated.

    Texts without words are one group like any other. Rows without a doc_id all stay.
    """
    keep = near_groups(docs, scratch, width, most).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id is null"))
