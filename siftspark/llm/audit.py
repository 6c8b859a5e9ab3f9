"""How filters interact: sorted posting lists of the rows that fail each, merged by galloping over ranges of row numbers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

FILTERS = "ABCDE"
#: A range of row numbers is 2 to this power wide: the longest posting list.
RANGE_BITS = 13
#: Ids that are looked for together, once the stretch that can hold them is found by galloping.
TOGETHER = 64
#: A text with more than one in so many rows is a large group; there are no more of them than this.
SHARE = 10_000
_MARKS = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))


def _failing(text: str) -> tuple[int, bytes]:
    """Bits of the filters A to D that a text fails, and the text's SHA-256."""
    raw = text.encode()
    words = raw.split()  # bytes split at ASCII white space alone
    n = len(words)
    bits = (n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > 2 * len(text)) << 2 | (_MARKS.search(raw) is not None) << 3
    return bits, hashlib.sha256(raw).digest()


def failures(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Of each row: uid, part (its source; null: empty), fails (a bit for each filter, A first), good, toxic.

    Null text counts as empty. E: the text (by SHA-256) stands under a smaller doc_id too; a null
    doc_id is no smaller nor larger. good and toxic: some label of the doc_id has quality 1, toxic 1.
    Texts are grouped by their hash after partial sums. Groups of over 1/10,000 of all rows, at most
    10,000 of them, meet their rows by broadcast, so no key of the other join has more rows than that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits, same = zip(*(_failing(t.as_py() or "") for t in b.column(2)), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bits, pa.int32()), pa.array(same, pa.binary())], ["doc_id", "part", "fails", "same"])

    x = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string"))
    x = x.mapInArrow(run, "doc_id long, part string, fails int, same binary").withColumn("uid", F.monotonically_increasing_id())
    x = scratch.save(x, "audit-fails")
    groups = x.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    groups = scratch.save(groups.select(F.col("same").alias("of"), "first", "copies"), "audit-groups")
    large = F.broadcast(groups.where(F.col("copies") * SHARE > F.lit(x.count())))
    here = F.col("same") == F.col("of")
    held = x.join(large, here).drop("of", "copies").unionByName(
        x.join(large, here, "left_anti").join(groups, here, "left").drop("of", "copies")
    )
    fails = F.col("fails") + F.when(F.col("first") < F.col("doc_id"), 16).otherwise(0)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("l_doc")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    held = held.join(marks.where("good or toxic"), F.col("doc_id") == F.col("l_doc"), "left")
    return held.select("uid", "part", fails.cast("int").alias("fails"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def postings(failed: DataFrame) -> DataFrame:
    """part, range of row numbers, and sorted lists of the numbers in it: those that fail each filter (A to E), good, toxic. A list holds one range's numbers at most."""
    low = F.col("uid").bitwiseAND(F.lit((1 << RANGE_BITS) - 1)).cast("int")
    lists = {f: F.col("fails").bitwiseAND(F.lit(1 << k)) > 0 for k, f in enumerate(FILTERS)} | {"good": F.col("good"), "toxic": F.col("toxic")}
    kept = [F.sort_array(F.collect_list(F.when(c, low))).alias(n) for n, c in lists.items()]
    return failed.groupBy("part", F.shiftright("uid", RANGE_BITS).alias("range")).agg(*kept)


def places(sought: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where each sought number stands, or would, in ids; both sorted. Galloping: steps double until they pass the last of some numbers, and only the stretch so found is searched."""
    out, at = np.empty(len(sought), np.int64), 0
    for k in range(0, len(sought), TOGETHER):
        some = sought[k : k + TOGETHER]
        step = 1
        while at + step < len(ids) and ids[at + step] < some[-1]:
            step *= 2
        found = at + np.searchsorted(ids[at : at + step + 1], some)
        out[k : k + TOGETHER], at = found, int(found[-1])
    return out


def without(ids: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The difference of two sorted lists."""
    if not len(ids) or not len(others):
        return ids
    at = places(ids, others)
    return ids[others[np.minimum(at, len(others) - 1)] != ids]


def union(lists: list[np.ndarray]) -> np.ndarray:
    """k sorted lists as one: what each adds is put in its place in the longer ones merged so far."""
    out = np.empty(0, np.int32)
    for ids in sorted(lists, key=len, reverse=True):
        new = without(ids, out)
        out = np.insert(out, places(new, out), new) if len(out) else new
    return out


def interactions(lists: DataFrame) -> DataFrame:
    """part, filter, others (bits), removed, good_lost, toxic_lost: rows that a filter (its number) removes after some of the others, for all sets of others, summed over ranges."""
    count = len(FILTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, part in enumerate(b.column(0).to_pylist()):
                ids = [b.column(2 + k)[i].values.to_numpy(zero_copy_only=False) for k in range(count + 2)]
                *failing, good, toxic = ids
                unions = {s: union([failing[k] for k in range(count) if s >> k & 1]) for s in range(1 << count)}
                for f, s in ((f, s) for f in range(count) for s in unions if not s >> f & 1):
                    gone = without(failing[f], unions[s])
                    if len(gone):
                        rows.append((part, f, s, len(gone), len(gone) - len(without(gone, good)), len(gone) - len(without(gone, toxic))))
            names = ["part", "filter", "others", "removed", "good_lost", "toxic_lost"]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "part" else pa.int32() if n in ("filter", "others") else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    found = lists.mapInArrow(run, "part string, filter int, others int, removed long, good_lost long, toxic_lost long")
    return found.groupBy("part", "filter", "others").agg(*[F.sum(c).alias(c) for c in ("removed", "good_lost", "toxic_lost")])


def audit(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Every order of the filters, step by step, for every part: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Row numbers are cut into ranges; the lists of a part and range are merged in one place, and
    sizes are summed, so neither a large part nor a large group of copies lies in one task. All 120
    orders follow from what each filter removes after each set of others (80 sums a part). Null
    sources are one part with the empty source; repeated rows count each time; parts are those that
    occur: no documents, no rows. Other columns are ignored.
    """
    failed = scratch.save(failures(docs, labels, scratch), "audit-rows")
    sums = scratch.save(interactions(postings(failed)), "audit-sums")
    last, spark = len(FILTERS) - 1, docs.sparkSession
    steps = [("".join(p), k + 1, FILTERS.index(f), sum(1 << FILTERS.index(g) for g in p[:k])) for p in permutations(FILTERS) for k, f in enumerate(p)]
    plan = spark.createDataFrame([(n, *s) for n, s in enumerate(steps)], "n int, filter_order string, step int, p_filter int, p_others int")  # 600 rows
    after = F.bit_count("others")
    ways = F.element_at(F.array(*[F.lit(factorial(k) * factorial(last - k)) for k in range(last + 1)]), (after + 1).cast("int"))
    whole = sums.groupBy(F.col("part").alias("w_part"), F.col("filter").alias("w_filter")).agg(
        F.sum(F.when(after == 0, F.col("removed"))).alias("failing"), F.sum(F.when(after == last, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * ways).alias("shapley")
    )
    parts = failed.groupBy(F.col("part").alias("of")).agg(F.count("*").alias("rows"))
    x = parts.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1)))).join(F.broadcast(plan), "n")
    x = x.join(sums, (F.col("of") == F.col("part")) & (F.col("p_filter") == F.col("filter")) & (F.col("p_others") == F.col("others")), "left")
    x = x.join(whole, (F.col("of") == F.col("w_part")) & (F.col("p_filter") == F.col("w_filter")), "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    x = x.select(F.col("of").alias("part"), "filter_order", "step", "rows", *[number(c).alias(c) for c in ("removed", "failing", "unique_fails", "good_lost", "toxic_lost", "shapley")])
    upto = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    return x.select(
        "part", "filter_order", "step", (F.col("rows") - upto).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
