"""Manifests of evidence for a judge, the budget of a prompt, and all reasons to review a verdict."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evidence import check_citations
from .views import identity

#: Letters of the handles of each category, framing tokens of a request, and bytes that count as a token.
LETTERS = {"SKILLS": "S", "EXPERIENCE": "E", "PROJECTS": "P", "EDUCATION": "D"}
FRAMING, TOKEN_BYTES = 128, 3


def with_handles(sentences: DataFrame) -> DataFrame:
    """Sentences (pair_id, category, ordinal, text) with handle, the category's letter and a number from 1, and scope, which changes with any of a pair's handles or texts."""
    letter = F.create_map(*[F.lit(v) for kv in LETTERS.items() for v in kv])[F.col("category")]
    n = F.row_number().over(Window.partitionBy("pair_id", "category").orderBy("ordinal", "text"))
    x = sentences.withColumn("handle", F.concat(letter, n.cast("string")))
    scope = x.groupBy("pair_id").agg(F.array_sort(F.collect_list(identity(F.col("handle"), F.col("text")))).alias("_all"))
    return x.join(scope.select("pair_id", F.sha2(F.array_join("_all", ""), 256).alias("scope")), "pair_id")


def within_budget(groups: DataFrame, limit_bytes: int, limit_tokens: int) -> DataFrame:
    """Source groups (pair_id, priority, bytes) that stay, those of least priority dropped first, until bytes and estimated tokens fit: used and tokens up to each."""
    w = Window.partitionBy("pair_id").orderBy("priority", "bytes").rowsBetween(Window.unboundedPreceding, 0)
    x = groups.withColumn("used", F.sum("bytes").over(w)).withColumn("tokens", F.ceil(F.col("used") / TOKEN_BYTES) + FRAMING)
    return x.where((F.col("used") <= limit_bytes) & (F.col("tokens") <= limit_tokens))


def verdicts(pairs: DataFrame, cited: DataFrame, registry: DataFrame, flags: DataFrame) -> DataFrame:
    """All reasons to review each pair, sorted, and its sorted distinct valid and invalid citations.

    pairs: pair_id, injected, truncated. cited: pair_id, category, citation. registry: pair_id, category, citation. flags: pair_id, category, severity.
    A reason is a category without evidence, one with a bad citation, a severe flag of a category without a valid citation, a sign of injection, or a context that was cut.
    """
    checked = check_citations(cited, registry)
    good = checked.where("reason is null")
    have = registry.select("pair_id", "category").distinct()
    wanted = pairs.select("pair_id", F.explode(F.array(*map(F.lit, LETTERS))).alias("category"))
    part = lambda df, name: df.select("pair_id", F.concat(F.lit(f"{name}:"), F.lower("category")).alias("reason"))
    one = lambda c, name: pairs.where(c).select("pair_id", F.lit(name).alias("reason"))
    severe = flags.where(F.col("severity").isin("HIGH", "CRITICAL")).select("pair_id", "category").distinct()
    reasons = [
        part(wanted.join(have, ["pair_id", "category"], "left_anti"), "MISSING_EVIDENCE"), part(checked.where("reason is not null"), "INVALID_CITATIONS"),
        part(severe.join(good.select("pair_id", "category").distinct(), ["pair_id", "category"], "left_anti"), "UNVERIFIED_FLAG"), one(F.col("injected"), "INJECTION_SIGNALS"), one(F.col("truncated"), "CONTEXT_TRUNCATED"),
    ]
    sets = lambda df, c, name: df.groupBy("pair_id").agg(F.array_join(F.sort_array(F.collect_set(c)), ",").alias(name))
    x = pairs.select("pair_id").join(sets(reduce(DataFrame.union, reasons), "reason", "reasons"), "pair_id", "left")
    x = x.join(sets(good, "citation", "valid"), "pair_id", "left").join(sets(checked.where("reason is not null"), "citation", "invalid"), "pair_id", "left")
    return x.fillna("", ["reasons", "valid", "invalid"])


def against_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (name, hash) and a manifest (name, hash) to name and code: ACCEPTED, MISMATCH, NOT_LISTED or MISSING."""
    x = files.join(manifest.select("name", F.col("hash").alias("expected")), "name", "full_outer")
    code = F.when(F.col("expected").isNull(), "NOT_LISTED").when(F.col("hash").isNull(), "MISSING").when(F.col("hash") != F.col("expected"), "MISMATCH").otherwise("ACCEPTED")
    return x.select("name", code.alias("code"))


#: The order in which categories take turns.
TURNS = ("CONTEXT", "EXPERIENCE", "PROJECTS", "SKILLS", "EDUCATION")


def taken(sizes: list[int | None], used: int, limit: int) -> list[bool | None]:
    """For each size in turn, whether it fits into what is left of limit; one that doesn't is passed over."""
    out: list[bool | None] = []
    for size in sizes:
        out.append(None if size is None else used + size <= limit)
        used += size if out[-1] else 0
    return out


def _fitting(limit: int):
    @F.arrow_udf("array<boolean>")
    def fitting(sizes: pa.Array, used: pa.Array) -> pa.Array:
        return pa.array([taken(s.as_py(), u.as_py(), limit) for s, u in zip(sizes, used, strict=True)], pa.list_(pa.bool_()))

    return fitting


def ordered_context(passages: DataFrame, hits: DataFrame, limit: int, terms: tuple[str, ...] = (), spent: DataFrame | None = None) -> DataFrame:
    """Passages (pair_id, idx, section, category, text) in the order in which a prompt takes them, and whether each is included: place, included.

    Passages with a mandatory term go first, then those at or next to a hit (pair_id, idx) in the same section, by idx, then all others, a
    category at a time in turn. Each that still fits into limit characters is included; one that does not is passed over.
    """
    at = hits.join(passages.select("pair_id", "idx", "section"), ["pair_id", "idx"]).select("pair_id", F.explode(F.array(F.col("idx") - 1, F.col("idx"), F.col("idx") + 1)).alias("idx"), "section").distinct()
    x = passages.join(at.withColumn("_near", F.lit(True)), ["pair_id", "idx", "section"], "left").withColumn("_near", F.coalesce("_near", F.lit(False)))
    turn = F.array_position(F.array(*map(F.lit, TURNS)), F.col("category"))
    n = F.row_number().over(Window.partitionBy("pair_id", "category").orderBy("idx"))
    must = reduce(lambda a, b: a | b, [F.contains(F.lower("text"), F.lit(t.lower())) for t in terms], F.lit(False))
    key = F.struct((~must).alias("m"), (~F.col("_near")).alias("n"), F.when(F.col("_near"), F.col("idx")).otherwise(F.col("_turn")).alias("a"), F.when(F.col("_near"), 0).otherwise(turn).alias("b"))
    x = x.withColumn("_turn", n).select("pair_id", "idx", key.alias("key"), F.length("text").alias("size"))
    rows = x.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("key", "idx", "size"))).alias("rows"))

    if spent is not None:
        rows = rows.join(spent, "pair_id", "left")
    before = F.coalesce("spent", F.lit(0)).cast("long") if spent is not None else F.lit(0).cast("long")
    fits = _fitting(limit)("rows.size", before)
    x = rows.select("pair_id", F.posexplode(F.arrays_zip(F.col("rows.idx").alias("idx"), fits.alias("included"))).alias("place", "r"))
    return x.select("pair_id", "r.idx", (F.col("place") + 1).alias("place"), "r.included")
