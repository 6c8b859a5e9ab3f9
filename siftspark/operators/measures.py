"""Distributions, rollups and agreement measures."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.sources.shared import shared_folder

from .numbering import numbered


def percentiles(df: DataFrame, keys: list[str], value: str, ps: tuple[float, ...], nearest: bool = False) -> DataFrame:
    """keys and p0, p1, ...: exact percentiles of each group by linear interpolation, or the values at the nearest ranks ceil(p n), nulls left out.

    Each value of a group is counted once; values lie in ranges by (keys, value), and prefix sums of the ranges'
    counts tell which few ranges hold the ranks wanted. Only these are ordered, so no task holds a whole group.
    """
    path = f"{shared_folder(df.sparkSession)}/percentiles-{uuid.uuid4().hex}"
    c = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    c = c.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id())
    c.write.parquet(path)
    c = df.sparkSession.read.schema(c.schema).parquet(path)
    sums = c.groupBy(*keys, "_part").agg(F.sum("_n").alias("_in"))
    w = Window.partitionBy(*keys)
    sums = sums.withColumn("_start", F.sum("_in").over(w.orderBy("_part")) - F.col("_in")).withColumn("_all", F.sum("_in").over(w))
    at = [F.greatest(F.ceil(F.col("_all") * F.lit(float(p))), F.lit(1)) - 1 if nearest else (F.col("_all") - 1) * F.lit(float(p)) for p in ps]
    ranks = [r for x in at for r in (F.floor(x), F.ceil(x))]
    held = reduce(or_, [(F.col("_start") <= r) & (r < F.col("_start") + F.col("_in")) for r in ranks])
    few = sums.where(held).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), "_start", "_all")
    x = c.join(few, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_part") == F.col("_p")))
    upto = F.col("_start") + F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_v"))
    x = x.withColumn("_upto", upto).groupBy(*keys).agg(F.first("_all").alias("_all"), *[
        F.max(F.when((F.col("_upto") - F.col("_n") <= r) & (r < F.col("_upto")), F.col("_v"))).alias(f"_r{i}") for i, r in enumerate(ranks)
    ])
    low = lambda i: F.col(f"_r{2 * i}")
    high = lambda i: F.col(f"_r{2 * i + 1}")
    between = lambda i, a: F.when(low(i) == high(i), low(i)).otherwise((F.ceil(a) - a) * low(i) + (a - F.floor(a)) * high(i))
    return x.select(*keys, *[between(i, a).alias(f"p{i}") for i, a in enumerate(at)])


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group: count, mean, p50 and p95 (linear interpolation) and max, 3 places; no values give nulls, and no keys one row."""
    p = percentiles(df.withColumn("_one", F.lit(1)), ["_one", *keys], value, (0.5, 0.95))
    p = p.select(*[F.col(k).alias(f"_g_{k}") for k in keys], "_one", "p0", "p1")
    x = df.groupBy(*keys).agg(F.count(value).alias("count"), F.round(F.avg(value), 3).alias("mean"), F.round(F.max(value), 3).alias("max"))
    x = x.join(p, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys], F.col("_one") == 1), "left")
    return x.select(*keys, "count", "mean", F.round("p0", 3).alias("p50"), F.round("p1", 3).alias("p95"), "max")


def nearest_rank(df: DataFrame, key: str, value: str, p: float = 0.95) -> DataFrame:
    """The value at rank ceil(p n) of each key."""
    return percentiles(df, [key], value, (p,), nearest=True).withColumnRenamed("p0", "p95")


def set_overlap(sets: DataFrame, name: str, item: str) -> DataFrame:
    """Items in common for every two sets a < b. Sets are ranked pools of bounded size."""
    a = sets.select(F.col(name).alias("a"), item).distinct()
    b = sets.select(F.col(name).alias("b"), item).distinct()
    return a.join(b, item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))


def recall_at(ranked: DataFrame, relevant: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """Share of each query's relevant items that stand at rank k or better."""
    hit = ranked.where(F.col("rank") <= k).select(query, item).withColumn("hit", F.lit(1))
    x = relevant.select(query, item).distinct().join(hit, [query, item], "left")
    return x.groupBy(query).agg((F.count("hit") / F.count("*")).alias("recall"))


def reconcile(pairs: DataFrame, expected: DataFrame, selected: Column, done: Column, cap: int) -> DataFrame:
    """Per job: pairs, terminal, selected, and whether the pairs are as many as expected (job, expected) with no more than cap selected. Jobs without pairs stay."""
    x = pairs.groupBy("job").agg(F.count("*").alias("pairs"), F.count_if(done).alias("terminal"), F.count_if(selected).alias("selected")).join(expected, "job", "full_outer")
    x = x.fillna(0, ["pairs", "terminal", "selected", "expected"])
    return x.withColumn("reconciled", (F.col("pairs") == F.col("expected")) & (F.col("selected") <= cap)).drop("expected")


def cost_estimates(events: DataFrame, keys: list[str], prices: dict[tuple, tuple[float, float]]) -> DataFrame:
    """Estimate of each group from prices of a million input and output tokens, six places; null without a price or any response with usage."""
    rate = lambda i: F.coalesce(*[F.when(F.expr(" and ".join(f"`{k}` = '{v}'" for k, v in zip(keys, name, strict=True))), F.lit(p[i])) for name, p in prices.items()])
    x = events.groupBy(*keys).agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.count_if("with_usage").alias("n"))
    return x.select(*keys, F.when(F.col("n") > 0, F.round((F.col("i") * rate(0) + F.col("o") * rate(1)) / 1_000_000, 6)).alias("estimate"))


def cutoff_ties(pairs: DataFrame, relevant: Column, cap: int) -> DataFrame:
    """Per job with cap pairs at least: how many share the score at the cap, how many are above it, and the precision at the cap."""
    w = Window.partitionBy("job").orderBy(F.desc("score"), "pair_id")
    top = pairs.withColumn("ok", relevant).withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)  # the first cap of a group are found before the shuffle
    cut = top.groupBy("job").agg(F.min(F.when(F.col("n") == cap, F.col("score"))).alias("cut"), (F.count_if("ok") / cap).alias("precision")).where("cut is not null")
    x = pairs.join(cut, "job").groupBy("job")
    return x.agg(F.count_if(F.col("score") == F.col("cut")).alias("tie_size"), F.count_if(F.col("score") > F.col("cut")).alias("above"), F.max("precision").alias("precision"))


#: Words by which a provider names its limits, and how it says what was asked for.
DAILY, MINUTE, REQUESTED = "tokens per day", "tokens per minute", r"requested\s*[:=]?\s*(\d+)"


def limit_error(message: Column) -> Column:
    """struct<error_code, requested> of a provider's refusal: which limit it names and how many tokens were asked for."""
    m = F.lower(message)
    code = F.when(F.contains(F.replace(m, F.lit("_"), F.lit(" ")), F.lit(DAILY)), "PROVIDER_DAILY_TOKEN_LIMIT").when(F.contains(m, F.lit(MINUTE)), "PROVIDER_MINUTE_TOKEN_LIMIT")
    n = F.nullif(F.regexp_extract(m, REQUESTED, 1), F.lit("")).cast("long")
    return F.struct(code.otherwise("PROVIDER_RATE_LIMITED").alias("error_code"), n.alias("requested"))


def dictionary_density(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Share of each text's words of two and more of the letters a to z that stand in the vocabulary's texts, two places; 0 without words."""
    words = lambda c: F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)")), lambda w: w.rlike("^[a-z]{2,}$"))
    known = vocabulary.select(F.explode(words(F.col("text"))).alias("w")).distinct().withColumn("hit", F.lit(1))
    n = docs.select("doc_id", F.explode(words(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    x = n.join(known, "w", "left").groupBy("doc_id").agg(F.round(F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)) / F.sum("n"), 2).alias("density"))
    return docs.select("doc_id").join(x, "doc_id", "left").fillna(0.0, ["density"])


def counter_deltas(samples: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Per key: last less first value by the order of samples, and the peak."""
    delta = F.max_by(value, at) - F.min_by(value, at)
    return samples.groupBy(key).agg(F.round(delta, 6).alias("delta"), F.max(value).alias("peak"))


def ranking_checks(ranked: DataFrame, key: str, item: str) -> DataFrame:
    """Per key of (key, item, rank, score): whether items are unique, ranks run from 1 without gaps, and scores never rise with the rank."""
    x = numbered(ranked, key, [F.col("rank"), F.col(item)], "_at")
    last = x.select(F.col(key).alias("_k"), (F.col("_at") + 1).alias("_next"), F.col("score").alias("_before"))
    x = x.join(last, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_at") == F.col("_next")), "left")
    x = x.withColumn("rise", F.coalesce(F.col("score") > F.col("_before"), F.lit(False)))
    return x.groupBy(key).agg(
        (F.count_distinct(item) == F.count("*")).alias("unique"), ((F.count_distinct("rank") == F.count("*")) & (F.min("rank") == 1) & (F.max("rank") == F.count("*"))).alias("contiguous"),
        (~F.bool_or("rise")).alias("sorted"),
    )


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand for more than one row, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


#: MiB in each unit of memory.
MEMORY = {"B": 1 / 1048576, "KiB": 1 / 1024, "MiB": 1.0, "GiB": 1024.0, "kB": 1000 / 1048576, "MB": 1000000 / 1048576, "GB": 1000000000 / 1048576}


def memory_mib(text: Column) -> Column:
    """The first amount of "12.5MiB / 2GiB" in MiB; 0 where it cannot be read."""
    own = F.replace(F.get(F.split(text, "/"), F.lit(0)), F.lit(" "), F.lit(""))
    unit = F.try_element_at(F.create_map(*[F.lit(v) for kv in MEMORY.items() for v in kv]), F.regexp_extract(own, r"^[\d.]+([A-Za-z]+)", 1))
    return F.coalesce(F.regexp_extract(own, r"^([\d.]+)[A-Za-z]+", 1).try_cast("double") * unit, F.lit(0.0))
