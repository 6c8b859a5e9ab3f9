"""The budget of a pair's context: retrieved chunks give way first, then passages fill what is left."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .manifests import ordered_context
from .planning import CATEGORIES


def losses(queues: list[int | None], keys: list[str], sizes: list[int], limit: int) -> tuple[list[int | None], int]:
    """Of a pair's chunks, in order of queue and place: for each its number among those taken away, and the characters that stay. Chunks without a queue don't count."""
    left, total = {q: [] for q in range(1, len(CATEGORIES) + 1)}, dict.fromkeys(range(1, len(CATEGORIES) + 1), 0)
    shared: dict[str, int] = {}
    used, omitted = 0, [None] * len(queues)
    for i, (q, key, size) in enumerate(zip(queues, keys, sizes, strict=True)):
        if q is not None:
            left[q].append(i)
            total[q] += size
            used += 0 if shared.get(key) else size
            shared[key] = shared.get(key, 0) + 1
    for no in range(1, len(queues) + 1):
        worst = max(total, key=lambda q: (total[q], -q))
        if used <= limit or not left[worst]:
            break
        i = left[worst].pop()
        omitted[i] = no
        total[worst] -= sizes[i]
        shared[keys[i]] -= 1
        used -= 0 if shared[keys[i]] else sizes[i]
    return omitted, used


def _fold(limit: int):
    kind = pa.struct([("omitted", pa.list_(pa.int32())), ("used", pa.int64())])

    @F.arrow_udf("omitted array<int>, used long")
    def fold(queues: pa.Array, keys: pa.Array, sizes: pa.Array) -> pa.Array:
        rows = (losses(q.as_py(), k.as_py(), s.as_py(), limit) for q, k, s in zip(queues, keys, sizes, strict=True))
        return pa.array([{"omitted": o, "used": u} for o, u in rows], kind)

    return fold


def within_budget(chunks: DataFrame, limit: int) -> DataFrame:
    """Retrieved chunks (pair_id, category, place, document_id, chunk_id, text) with omitted (its number among those taken away, null where it stays) and evidence_chars.

    Categories are queues in order of place. While the distinct chunks of a pair have more than
    limit characters, the last chunk of the largest category goes, whole; of equal categories the
    first loses. What a chunk holds counts once, however many categories share it (the same document,
    chunk and text; without a chunk_id the text alone tells), while a category's own size counts all
    of its chunks. A pair's chunks are those that retrieval returned, k a category at most, so the
    fold over them stays in one row, and takes time in proportion to them. Null texts count as empty; repeated rows are places of their own.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.sha2(F.to_json(F.struct(F.col("document_id").cast("string").alias("d"), F.coalesce(F.col("chunk_id").cast("string"), F.lit("")).alias("c"), text.alias("t"))), 256)
    number = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")).cast("int")
    row = F.struct(number.alias("queue"), "place", key.alias("key"), F.length(text).cast("long").alias("size"), "document_id", "chunk_id")
    x = chunks.groupBy("pair_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    x = x.withColumn("end", _fold(limit)("rows.queue", "rows.key", "rows.size")).select("pair_id", F.col("end.used").alias("evidence_chars"), F.explode(F.arrays_zip(F.col("rows").alias("row"), F.col("end.omitted").alias("omitted"))).alias("c"))
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), F.col("c.row.queue"))
    return x.select("pair_id", category.alias("category"), "c.row.place", "c.row.document_id", "c.row.chunk_id", "c.omitted", "evidence_chars")


def filled(budget: DataFrame, passages: DataFrame, limit: int, terms: tuple[str, ...] = ()) -> DataFrame:
    """What within_budget leaves of the limit, filled with passages (pair_id, idx, section, category, text) in the order of ordered_context; chunks that stay, whose chunk_id is a passage's idx, are the hits."""
    kept = budget.where("omitted is null")
    hits = kept.select("pair_id", F.col("chunk_id").alias("idx")).where("idx is not null").distinct()
    return ordered_context(passages, hits, limit, terms, budget.select("pair_id", F.col("evidence_chars").alias("spent")).distinct())
