"""The union of intervals as an aggregate whose partial states are sorted disjoint intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftspark.sources.shared import stored

#: Spans that a task holds at once before it merges them.
HELD = 1 << 18


def _merged_by_key(x: pd.DataFrame) -> pd.DataFrame:
    """Spans (k, a, b) with each key's merged."""
    x = x.sort_values(["k", "a", "b"], kind="stable")
    keys, a, b = pd.factorize(x["k"])[0], x["a"].to_numpy(), x["b"].to_numpy()
    if not len(x):
        return x
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    ends = np.concatenate((starts[1:], [len(x)]))
    keep, reach = np.zeros(len(x), bool), b.copy()
    for s, e in zip(starts, ends, strict=True):
        r = np.maximum.accumulate(b[s:e])
        new = np.flatnonzero(np.concatenate(([True], a[s + 1 : e] > r[:-1])))
        keep[s + new] = True
        reach[s + new] = r[np.concatenate((new[1:] - 1, [e - s - 1]))]
    return pd.DataFrame({"k": x["k"].to_numpy()[keep], "a": a[keep], "b": reach[keep]})


def _partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merges a task's spans, HELD at a time; a merged state is merged on with what comes, until it is too large to hold."""
    state = None
    for frame in frames:
        state = frame if state is None else pd.concat([state, frame])
        if len(state) >= HELD:
            state = _merged_by_key(state)
            if len(state) >= HELD // 2:
                yield state
                state = None
    if state is not None:
        yield _merged_by_key(state)


def interval_union(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, covered, islands: the length of the union of each key's spans, and of how many disjoint intervals it is made; touching spans are one.

    Tasks merge their own spans before anything is shuffled. What is left is dealt by ranges of key and start, so that one key may fill many
    tasks: each range takes over the furthest end of the key in the ranges before it, a prefix maximum over one row for each key and range.
    Start and end are whole numbers; spans with a null key, start or end, or that end before they start, do not count.
    """
    x = spans.select(F.col(key).alias("k"), F.col(start).cast("long").alias("a"), F.col(end).cast("long").alias("b")).where("k is not null and a <= b")
    x = x.mapInPandas(_partial, x.schema)
    x = stored(x.repartitionByRange("k", "a").withColumn("part", F.spark_partition_id()), "intervals")
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    reach = x.groupBy("k", "part").agg(F.max("b").alias("m")).select(F.col("k").alias("_k"), F.col("part").alias("_part"), F.max("m").over(before).alias("reach"))
    x = x.join(reach, (F.col("k") == F.col("_k")) & (F.col("part") == F.col("_part")))
    inside = Window.partitionBy("k", "part").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("upto", F.greatest("reach", F.max("b").over(inside)))
    new = F.col("upto").isNull() | (F.col("a") > F.col("upto"))
    more = F.when(new, F.col("b") - F.col("a")).otherwise(F.greatest(F.col("b") - F.col("upto"), F.lit(0)))
    return x.groupBy(F.col("k").alias(key)).agg(F.sum(more).alias("covered"), F.count_if(new).alias("islands"))
