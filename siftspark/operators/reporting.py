"""Reports: exports, audits, counts and rates, each in one or two aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.functions.text import spreadsheet_safe

from .measures import distribution
from .pages import XML

#: Namespace of document ids (that of URLs), edges of the score bands, error classes by the provider's status.
NAMESPACE, BANDS = "6ba7b8119dad11d180b400c04fd430c8", (0, 55, 75, 101)
UNAVAILABLE, CONFIGURATION = (500, 502, 503, 504), (400, 401, 403, 404)


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """The name-based identifier of version 5: sha1 of namespace and name, with its version and variant bits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def export_rows(pool: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as texts that a spreadsheet can't run: lists joined by "; ", tags by ", ", nulls empty."""

    def cell(c: str) -> Column:
        kind = dict(pool.dtypes)[c]
        flat = F.array_join(F.col(c), ", " if c == "tags" else "; ") if kind.startswith("array") else F.col(c).cast("string")
        return spreadsheet_safe(F.coalesce(flat, F.lit(""))).alias(c)

    return pool.select(*map(cell, columns))


def unsafe_xml(text: Column) -> Column:
    """Whether a text holds a code point that XML does not allow, for a check that refuses it."""
    return text.rlike(f"[^{XML}]")


def sealed_requirement(text: Column) -> Column:
    """A requirement inside its tag; the tag's own name in the text is made harmless, the rest stays."""
    safe = F.replace(F.replace(text, F.lit("</job_description>"), F.lit("&lt;/job_description&gt;")), F.lit("<job_description>"), F.lit("&lt;job_description&gt;"))
    body = F.regexp_replace(safe, r"^\s+|\s+$", "")
    return F.when(F.coalesce(text, F.lit("")) == "", "<job_description>\n</job_description>").otherwise(F.concat(F.lit("<job_description>\n"), body, F.lit("\n</job_description>")))


def leak_counts(masked: DataFrame, known: DataFrame, done: Column) -> DataFrame:
    """One row of counts of masked texts (doc_id, text, raw_kept) that hold a name, mail, location or phone known of their document, and of finished ones with their raw bytes still kept.

    A phone counts by its digits, eight or more, in the text's digits; extensions don't belong to it.
    """
    x = masked.join(known, "doc_id", "left")
    holds = lambda c: F.coalesce(F.contains(F.lower("text"), F.lower(c)), F.lit(False))
    digits = F.regexp_replace(F.get(F.split("phone", r"(?i)x|ext\.?\s*"), F.lit(0)), r"\D", "")
    phone = (F.length(digits) >= 8) & F.contains(F.regexp_replace("text", r"\D", ""), digits)
    return x.agg(
        F.count("*").alias("documents"), *[F.count_if(holds(c)).alias(c) for c in ("name", "mail", "location")], F.count_if(F.coalesce(phone, F.lit(False))).alias("phone"),
        F.count_if(done & F.col("raw_kept")).alias("raw_bytes"),
    )


def by_category(sentences: DataFrame) -> DataFrame:
    """(doc_id, category, start, ...) with ordinal, from 1 in each document's category by start."""
    return sentences.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id", "category").orderBy("start")))


def experience(merged: DataFrame) -> DataFrame:
    """Months covered and islands of each key to months, years, and the upper bound of the years that whole months leave open."""
    return merged.withColumnRenamed("covered", "months").withColumns({"years": F.round(F.col("months") / 12, 2), "most_years": F.round((F.col("months") + F.col("islands")) / 12, 2)}).drop("islands")


def stale_drafts(drafts: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Drafts (status, updated) that have been in work for longer than that fail."""
    gone = (F.col("status") == "PROCESSING") & (F.unix_seconds(now) - F.unix_seconds(F.col("updated").cast("timestamp")) > 60 * minutes)
    return drafts.withColumns({"status": F.when(gone, "FAILED").otherwise(F.col("status")), "error": F.when(gone, "PROCESSING_TIMEOUT")})


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of a list, with the number of rows that there are in all."""
    total = df.agg(F.count("*").alias("total"))  # one row
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def requirement_grid(pairs: DataFrame, targets: DataFrame, assessments: DataFrame) -> DataFrame:
    """How many pairs of each job stand in each state of each of its targets; without an assessment UNASSESSED. Pairs are counted by job, so no row stands for a pair and target."""
    n = pairs.groupBy("job").agg(F.count("*").alias("pairs"))
    known = assessments.groupBy("job", "target_id", F.when(F.col("status") == "MISSING_INFORMATION", "MISSING").otherwise(F.col("status")).alias("state")).agg(F.count_distinct("pair_id").alias("n"))
    had = known.groupBy("job", "target_id").agg(F.sum("n").alias("had"))
    left = targets.join(n, "job").join(had, ["job", "target_id"], "left").select("job", "target_id", F.lit("UNASSESSED").alias("state"), (F.col("pairs") - F.coalesce("had", F.lit(0))).alias("n"))
    return known.join(targets, ["job", "target_id"], "left_semi").select("job", "target_id", "state", "n").union(left.where("n > 0"))


def providers(events: DataFrame) -> DataFrame:
    """Per provider and model: latency distribution, and how often each resolved model answered, as model=count."""
    keys = ["provider", "model"]
    d = distribution(events, keys, "latency")
    r = events.where("resolved is not null").groupBy(*keys, "resolved").agg(F.count("*").alias("n"))
    r = r.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("resolved", "n"))), lambda x: F.concat_ws("=", x["resolved"], x["n"].cast("string"))), ",").alias("resolved"))
    return d.join(r, keys, "left")


def reported_costs(events: DataFrame) -> DataFrame:
    """One row: the reported cost, only where every response with usage has one, and the partial sum there is."""
    x = events.agg(F.count("cost").alias("n"), F.count_if("with_usage").alias("u"), F.round(F.sum("cost"), 6).alias("partial_cost"))
    return x.select(F.when((F.col("n") == F.col("u")) & (F.col("n") > 0), F.col("partial_cost")).alias("reported_cost"), "partial_cost")


def resources(samples: DataFrame) -> DataFrame:
    """Samples (at, container, cpu, memory) to distributions of cpu and memory by container, and, as container null, of the total memory of a sample."""
    own = [distribution(samples, ["container"], c).select(F.lit(c).alias("metric"), "container", "count", "mean", "p50", "p95", "max") for c in ("cpu", "memory")]
    total = distribution(samples.groupBy("at").agg(F.sum("memory").alias("memory")), [], "memory")
    total = total.select(F.lit("memory").alias("metric"), F.lit(None).cast("string").alias("container"), "count", "mean", "p50", "p95", "max")
    return own[0].union(own[1]).union(total)


def rates(outcomes: DataFrame) -> DataFrame:
    """One row for (label, decision): precision and recall of shortlists, shares of reviews and errors; null where nothing is divided."""
    short, right = F.col("decision") == "shortlist", F.col("label") == "shortlist"
    share = lambda a, b: F.round(F.try_divide(F.count_if(a).cast("double"), b.cast("double")), 6)
    return outcomes.agg(
        F.count("*").alias("n"), share(short & right, F.count_if(short)).alias("precision"), share(short & right, F.count_if(right)).alias("recall"),
        share(F.col("decision") == "review", F.count("*")).alias("reviews"), share(F.col("decision") == "error", F.count("*")).alias("errors"),
    )


def replay_counts(pairs: DataFrame, cap: int) -> DataFrame:
    """Per job: pairs, those with score 0, and of the first cap those with score 0 and those not relevant."""
    w = Window.partitionBy("job").orderBy(F.desc("score"), "pair_id")
    top = pairs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)
    top = top.groupBy("job").agg(F.count("*").alias("selected"), F.count_if(F.col("score") == 0).alias("selected_zero"), F.count_if(~F.col("relevant")).alias("unrelated"))
    return pairs.groupBy("job").agg(F.count("*").alias("pairs"), F.count_if(F.col("score") == 0).alias("zero")).join(top, "job")


def benchmark_overlap(pairs: DataFrame, cap: int) -> DataFrame:
    """Per job: how many selected pairs there are, how many are among the best cap by expected relevance of those not expected to fail, and how many were expected to fail."""
    w = Window.partitionBy("job").orderBy(F.desc("relevance"), "pair_id")
    ideal = pairs.where(~F.col("expected_fail")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).select("pair_id", F.lit(1).alias("ideal"))
    x = pairs.where("selected").join(ideal, "pair_id", "left").groupBy("job")
    return x.agg(F.count("*").alias("selected"), F.count("ideal").alias("overlap"), F.count_if("expected_fail").alias("expected_fail"))


def bands(score: Column) -> Column:
    """The score's band, from its lower edge on; null outside of all."""
    return F.coalesce(*[F.when((score >= a) & (score < b), F.lit(f"{a}-{b}")) for a, b in zip(BANDS, BANDS[1:], strict=False)])


def size_summary(sizes: DataFrame) -> DataFrame:
    """One row for (before, after): ranges of both, mean size after, and the mean of the reductions in per cent (one place each)."""
    cut = F.round((F.col("before") - F.col("after")) * 100.0 / F.col("before"), 1)
    return sizes.agg(
        F.count("*").alias("pairs"), F.min("before").alias("before_least"), F.max("before").alias("before_most"), F.min("after").alias("after_least"), F.max("after").alias("after_most"),
        F.round(F.avg("after"), 0).alias("mean_after"), F.round(F.round(F.avg(cut), 6), 1).alias("mean_reduction"),
    )


def provider_error(status: Column, limit: Column, parsed: Column) -> Column:
    """The class of a provider's answer: limits by its message (limit), unavailable, wrong configuration, or an answer that can't be read."""
    return (
        F.when(status == 429, limit).when(status.isin(*UNAVAILABLE), "PROVIDER_UNAVAILABLE").when(status.isin(*CONFIGURATION), "PROVIDER_CONFIGURATION").when(~parsed, "INVALID_OUTPUT")
    )


def same_ids(expected: DataFrame, public: dict[str, DataFrame]) -> DataFrame:
    """One row: ids that no public list has, that several have, and that were not expected."""
    lists = reduce(lambda a, b: a.union(b), [df.select("id", F.lit(n).alias("name")) for n, df in public.items()])
    seen = lists.groupBy("id").agg(F.count("*").alias("n"))
    x = expected.select("id", F.lit(True).alias("e")).join(seen, "id", "full_outer")
    return x.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("e").isNull()).alias("unexpected"))


def registry_faults(chunks: DataFrame, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Chunks (pair_id, owner, category, source, chunk_id, text) that a registry refuses: FOREIGN_OWNER, BAD_SOURCE, or, of one id with several contents, CONFLICT."""
    table = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(s).alias("s")) for c, ss in allowed.items() for s in (*ss, "CONTEXT")])
    fits = F.exists(table, lambda t: (t["c"] == F.col("category")) & (t["s"] == F.col("source")))
    bad = chunks.select("pair_id", "chunk_id", F.explode(F.array_compact(F.array(F.when(F.col("owner") != F.col("pair_id"), "FOREIGN_OWNER"), F.when(~fits, "BAD_SOURCE")))).alias("fault")).distinct()
    clash = chunks.groupBy("pair_id", "chunk_id").agg(F.count_distinct(F.sha2("text", 256)).alias("n")).where("n > 1").select("pair_id", "chunk_id", F.lit("CONFLICT").alias("fault"))
    return bad.union(clash)


def failure_groups(pairs: DataFrame) -> DataFrame:
    """Per status and failure code: pairs and the sum of their attempts."""
    return pairs.groupBy("status", "failure_code").agg(F.count("*").alias("pairs"), F.sum("attempts").alias("attempts"))

