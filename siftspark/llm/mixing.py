"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, spare

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, target): a share of all words by weight.

    Sources in code-point order, null last, take the weights in turn. A target stops at ``most``
    times its source's size; what lies above is shared anew by weight until none is above. That
    fixed point is the water level: the largest of (total - capped before) / (weights from here on)
    with sources in order of cap / weight. The input has one row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = (F.row_number().over(order) - 1) % len(weights)
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (n + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.col("source_size").cast("double") * most)
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total.cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("level", level)
    target = F.least(F.col("cap"), F.col("w") * F.max("level").over(Window.partitionBy()))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix-1", digits: int = 3) -> DataFrame:
    """Take words of every source up to its target.

    Each document gets the md5 of seed and doc_id as its random key. Documents of a source are cut
    into 16**digits ranges of the key; sums over the ranges give each range its start, and a window
    inside a range the rest, so that a source of any share is spread over many tasks. The budget
    (the target, rounded) is cut exactly: whole epochs repeat all documents, then the order is read
    until the budget ends, the last document being taken in part.

    Returns doc_id, size, source_size, target, taken, source, key. Null or blank text: size 0 and taken 0.
    Null sources form one source. Null doc_ids share the key of the empty string. Repeated rows
    count each time (ties are ordered by doc_id and size). Other columns are ignored.
    """
    d = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    d = d.withColumn("key", F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    d = scratch.save(d.withColumn("part", F.substring("key", 1, digits)), "mix-sizes")
    ranges = d.groupBy("source", "part").agg(F.sum("size").alias("n"))
    start = F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")
    ranges = ranges.withColumn("start", start)
    goal = source_targets(ranges.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most)
    g = goal.select(F.col("source").alias("g_source"), "source_size", "target")
    r = ranges.join(g, F.col("source").eqNullSafe(F.col("g_source"))).select(
        F.col("source").alias("r_source"), F.col("part").alias("r_part"), "start", "source_size", "target"
    )
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size")
    x = d.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.join(r, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("part") == F.col("r_part")))
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size")
    left = F.least(F.col("size"), F.greatest(F.lit(0), rest - (F.col("start") + F.col("upto") - F.col("size"))))
    taken = (whole * F.col("size") + left).cast("long")
    return x.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "key")


def mixed_documents(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs.

    A document taken k + f times (0 <= f < 1) appears k times, and once more if f >= 1/2; whole
    texts only. Blank documents are taken 0 times. Rows with one doc_id share the largest count.
    """
    own, times, one = spare(docs, "_mix_id", "_mix_times", "_mix_one")
    m = mix(docs, scratch, **options).where("taken > 0").groupBy(F.col("doc_id").alias(own)).agg(
        F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias(times)
    )
    out = docs.join(m, F.col("doc_id").eqNullSafe(F.col(own))).where(F.col(times) > 0)
    repeated = out.withColumn(one, F.explode(F.sequence(F.lit(1), F.col(times))))
    return repeated.select(*docs.columns)
