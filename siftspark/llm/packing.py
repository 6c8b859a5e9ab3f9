"""Best-fit packing of token sequences: bulk-synchronous rounds of distributed successor matching."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import encoder, is_plain

#: Items of one size and kind that one task puts in order.
ROWS_PER_SALT = 2_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: UTF-8 characters encoded at once.
CHARS_AT_ONCE = 1 << 20


def pieces(docs: DataFrame, vocabulary: str, limit: int = 4096, end_id: int = 1) -> DataFrame:
    """Documents as token pieces: ids of the text, then end_id, cut every limit ids.

    Null text counts as empty: one piece of one id. Returns doc_id, piece, start, length, ids_crc32.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    plain = is_plain(vocabulary)
    end, width = np.array([end_id], "<u4").tobytes(), 4 * limit

    def texts(b: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
        ids, held, n = [], [], 0
        for i, t in zip(b.column(0), b.column(1), strict=True):
            ids.append(i.as_py())
            held.append(t.as_py() or "")
            n += len(held[-1])
            if n > CHARS_AT_ONCE:
                yield ids, held
                ids, held, n = [], [], 0
        if ids:
            yield ids, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, plain).encode
        for b in batches:
            for ids, held in texts(b):
                rows = []
                for i, raw in zip(ids, encode(held), strict=True):
                    raw += end
                    for k, a in enumerate(range(0, len(raw), width)):
                        part = raw[a : a + width]
                        rows.append((i, k, a // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def _matched(docs: DataFrame, slots: DataFrame, salts: int) -> DataFrame:
    """Best fit of docs (uid, size) to slots (bin, j, size), at most one each: uid, size, bin, j (bin null: no fit).

    Both are sorted together by falling size, slots first. Reading on, a slot opens a level and a
    document closes the newest open one, which is the smallest slot it fits in; so the document at a
    level is matched to the slot just before it at that level. Levels are prefix sums: counts by
    (size, kind, salt) are summed over at most limit sizes, the rank in a salt is a window over
    its rows. Rows of one level alternate between the sizes, so a level has two rows a size at most.
    """
    items = slots.select("size", F.lit(0).alias("kind"), F.col("bin").alias("id"), "j").union(
        docs.select("size", F.lit(1).alias("kind"), F.col("uid").alias("id"), F.lit(0).alias("j"))
    )
    items = items.withColumn("salt", F.pmod(F.xxhash64("id", "j"), F.lit(salts)).cast("int"))
    counts = items.groupBy("size", "kind", "salt").agg(F.count("*").alias("n"))
    by_size = counts.groupBy("size").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("opens"), F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("closes")
    )
    above = F.sum(F.col("opens") - F.col("closes")).over(Window.orderBy(F.desc("size"))) - (F.col("opens") - F.col("closes"))
    by_size = by_size.select(F.col("size").alias("s"), "opens", above.alias("above"))
    before = F.sum("n").over(Window.partitionBy("size", "kind").orderBy("salt")) - F.col("n")
    at = counts.withColumn("before", before).join(by_size, F.col("size") == F.col("s"))
    at = at.select(
        F.col("size").alias("a_size"), F.col("kind").alias("a_kind"), F.col("salt").alias("a_salt"),
        F.when(F.col("kind") == 0, F.col("above") + F.col("before")).otherwise(F.col("above") + F.col("opens") - F.col("before") + 1).alias("base"),
    )
    r = F.row_number().over(Window.partitionBy("size", "kind", "salt").orderBy("id", "j"))
    x = items.withColumn("r", r).join(at, (F.col("size") == F.col("a_size")) & (F.col("kind") == F.col("a_kind")) & (F.col("salt") == F.col("a_salt")))
    x = x.withColumn("level", F.when(F.col("kind") == 0, F.col("base") + F.col("r")).otherwise(F.col("base") - F.col("r")))
    w = Window.partitionBy("level").orderBy(F.desc("size"), "kind")
    open_ = F.lag("kind").over(w) == 0
    x = x.select("kind", F.col("id").alias("uid"), "size", F.when(open_, F.lag("id").over(w)).alias("bin"), F.when(open_, F.lag("j").over(w)).alias("j"))
    return x.where("kind = 1").drop("kind")


def best_fit(items: DataFrame, scratch: Scratch, limit: int, name: str = "fit") -> DataFrame:
    """Bins of at most limit for items (uid long >= 0, unique; length 1..limit): uid, sequence_id, offset.

    Items over half the limit open a bin each. Then rounds: open as many bins as the rest surely
    needs (its volume beyond the free space, or that of items larger than any gap), cut the gaps
    into slots of the largest item's size, match best-fit, fill the gaps, repeat. A round that
    places nothing opens bins for all that is left. Offsets are gapless from 0.
    """
    items = items.select("uid", F.col("length").cast("int").alias("size"))
    big = items.where(F.col("size") * 2 > limit)
    done = big.select("uid", F.col("uid").alias("bin"), F.lit(0).alias("offset"))
    scratch.save(done, f"{name}/placed/0")
    bins = scratch.save(big.select(F.col("uid").alias("bin"), F.col("size").alias("used")), f"{name}/bins-0")
    left = items.where(F.col("size") * 2 <= limit)
    step, opened, before = 0, 0, None
    while True:
        s = left.agg(F.count("*").alias("n"), F.sum("size").alias("volume"), F.min("size").alias("low"), F.max("size").alias("high")).first()
        if not s.n:
            break
        free = F.lit(limit) - F.col("used")
        gaps = bins.select("bin", "used", free.cast("int").alias("free")).where(F.col("free") >= s.low)
        g = gaps.agg(F.count("*").alias("n"), F.sum("free").alias("volume"), F.max("free").alias("high")).first()
        need = max(0, ceil((s.volume - (g.volume or 0)) / limit))
        if s.high > (g.high or 0):
            need = max(need, ceil(left.where(F.col("size") > (g.high or 0)).agg(F.sum("size")).first()[0] / limit))
        if s.n == before:
            need = max(need, ceil(s.volume / limit))
        before, step = s.n, step + 1
        new = scratch.spark.range(opened, opened + need).select((-1 - F.col("id")).alias("bin"), F.lit(0).alias("used"), F.lit(limit).alias("free"))
        opened += need
        gaps = gaps.union(new) if g.n else new
        most = max(1, ceil(2 * s.n / ((g.n or 0) + need)))
        k = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("free") / s.high))).cast("int")
        slots = gaps.withColumn("k", k).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        slots = slots.select("bin", "j", F.when(F.col("j") < F.col("k") - 1, s.high).otherwise(F.col("free") - (F.col("k") - 1) * s.high).cast("int").alias("size"))
        m = scratch.save(_matched(left, slots, 1 + (s.n + (g.n or 0)) // ROWS_PER_SALT), f"{name}/round-{step}")
        left, hit = m.where("bin is null").select("uid", "size"), m.where("bin is not null")
        upto = F.sum("size").over(Window.partitionBy("bin").orderBy("j", "uid")) - F.col("size")
        was = gaps.select(F.col("bin").alias("b"), F.col("used").alias("was"))
        put = hit.withColumn("upto", upto).join(was, F.col("bin") == F.col("b"))
        scratch.save(put.select("uid", "bin", (F.col("was") + F.col("upto")).cast("int").alias("offset")), f"{name}/placed/{step}")
        added = hit.groupBy(F.col("bin").alias("b")).agg(F.sum("size").alias("more"))
        now = gaps.join(added, F.col("bin") == F.col("b"), "left").select("bin", (F.col("used") + F.coalesce("more", F.lit(0))).cast("int").alias("used"))
        bins = scratch.save(now, f"{name}/bins-{step}")
        scratch.drop(f"{name}/bins-{step - 1}")
        if step > 1:
            scratch.drop(f"{name}/round-{step - 1}")
    placed = scratch.read_all(f"{name}/placed", done)
    return placed.select("uid", F.col("bin").alias("sequence_id"), F.col("offset").cast("long"))


def pack(docs: DataFrame, scratch: Scratch, vocabulary: str, limit: int = 4096, end_id: int = 1) -> DataFrame:
    """Packs all documents into sequences of at most limit tokens: the columns of pieces(), sequence_id, offset.

    Null and empty texts are one piece of the end id; repeated rows are packed each; a null doc_id
    stays null; other columns are ignored; no documents, no rows.
    """
    p = scratch.save(pieces(docs, vocabulary, limit, end_id), "pack-pieces").withColumn("uid", F.monotonically_increasing_id())
    p = scratch.save(p, "pack-uid")
    return p.join(best_fit(p, scratch, limit), "uid").drop("uid")
