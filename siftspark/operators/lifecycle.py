"""State changes of pairs, requests, drafts and reviews, as joins of stored rows with new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered
from .ranking import TERMINAL


def extraction_failures(pairs: DataFrame, failed: DataFrame) -> DataFrame:
    """Pairs (doc_id, status) of documents (doc_id, error_code) that could not be read fail unless their state is final."""
    x = pairs.join(failed, "doc_id", "left").withColumn("hit", F.col("error_code").isNotNull() & ~F.col("status").isin(*TERMINAL))
    out = x.withColumn("status", F.when(F.col("hit"), "EXTRACTION_FAILED").otherwise(F.col("status")))
    return out.withColumn("failure_code", F.when(F.col("hit"), F.col("error_code"))).drop("hit", "error_code")


def terminal_write(old: Column, new: Column, same: Column, score: Column) -> Column:
    """What a write of a final state does: REJECTED, NO_OP for the same again, CONFLICT, or WRITTEN."""
    return (
        F.when(~new.isin(*TERMINAL), "REJECTED").when(old.isin(*TERMINAL), F.when((old == new) & same, "NO_OP").otherwise("CONFLICT"))
        .when((new == "SUCCESS") & score.isNull(), "REJECTED").otherwise("WRITTEN")
    )


def replays(requests: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Requests (keys, request_hash) with action: NEW, REPLAY of a finished one, IN_PROGRESS, or CONFLICT with another request's key."""
    s = stored.select(*keys, F.col("request_hash").alias("was"), "finished")
    x = requests.join(s, keys, "left")
    action = F.when(F.col("was").isNull(), "NEW").when(F.col("was") != F.col("request_hash"), "CONFLICT").when(F.col("finished"), "REPLAY").otherwise("IN_PROGRESS")
    return x.withColumn("action", action).drop("was", "finished")


def stale(status: Column, lease: Column, now: Column, attempts: Column, most: int) -> Column:
    """struct<status, failure_code> after expired leases: tried often enough it fails, else it waits again."""
    gone = F.coalesce((status == "RUNNING") & (lease < now), F.lit(False))
    over = gone & (attempts >= most)
    to = F.when(over, "PROCESSING_FAILED").when(gone, "PENDING").otherwise(status)
    return F.struct(to.alias("status"), F.when(over, "RETRIEVAL_ATTEMPTS_EXHAUSTED").alias("failure_code"))


def reviews(events: DataFrame) -> DataFrame:
    """Events (pair_id, seq, decision, reason, notes, tags) folded to the review they leave: notes and tags stay where an event has none.

    An event without the reason that NOT_PROCEEDING asks for does not count. version is the number of those that do.
    """
    ok = (F.col("decision") != "NOT_PROCEEDING") | (F.trim(F.coalesce("reason", F.lit(""))) != "")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    x = events.where(ok).groupBy("pair_id").agg(
        F.count("*").alias("version"), F.max_by("decision", "seq").alias("decision"), F.max_by(F.trim(F.coalesce("reason", F.lit(""))), "seq").alias("reason"), last("notes"), last("tags")
    )
    return x.withColumn("notes", F.coalesce("notes", F.lit("")))


def pool_order(key: str, descending: bool, item: str = "pair_id") -> list[Column]:
    """By the key either way, unknown ones always last, then by id."""
    return [F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last(), F.col(item).asc()]


def ranks(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Adds place in each group, which may be of any size."""
    return numbered(df, group, order)
