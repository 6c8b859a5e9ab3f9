"""Intake of file manifests, identities and idempotent writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def manifest_report(files: DataFrame, suffix: str = ".pdf", most: int = 5_000_000) -> DataFrame:
    """(ordinal, path, length) with code: UNSAFE_PATH, DUPLICATE_NAME, NOT_PDF, TOO_LARGE or ACCEPTED.

    Names are compared without case; among safe files the first in order keeps the name, whatever becomes of it.
    """
    safe = ~(F.col("path").startswith("/") | F.col("path").contains("\\") | F.col("path").rlike(r"(^|/)\.\.(/|$)"))
    leaf = F.lower(F.substring_index("path", "/", -1))
    x = files.withColumn("safe", safe).withColumn("leaf", leaf)
    nth = F.row_number().over(Window.partitionBy("safe", "leaf").orderBy("ordinal"))
    code = (
        F.when(~F.col("safe"), "UNSAFE_PATH").when(F.col("nth") > 1, "DUPLICATE_NAME").when(~F.col("leaf").endswith(suffix), "NOT_PDF")
        .when(F.col("length") > most, "TOO_LARGE").otherwise("ACCEPTED")
    )
    return x.withColumn("nth", nth).select("ordinal", code.alias("code"))


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: keys that are not there yet."""
    return incoming.join(existing.select(*keys), keys, "left_anti")


def versioned_upsert(old: DataFrame, new: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """Both sides by key; a new row wins where the version or the value changed. Adds action: KEPT, UPDATED, INSERTED."""
    o = old.select(F.col(key).alias("ok"), F.col(version).alias("ov"), F.col(value).alias("oval"))
    n = new.select(F.col(key).alias("nk"), F.col(version).alias("nv"), F.col(value).alias("nval"))
    x = o.join(n, F.col("ok") == F.col("nk"), "full_outer")
    changed = F.col("nk").isNotNull() & ~(F.col("ov").eqNullSafe(F.col("nv")) & F.col("oval").eqNullSafe(F.col("nval")))
    action = F.when(F.col("ok").isNull(), "INSERTED").when(changed, "UPDATED").otherwise("KEPT")
    pick = lambda a, b: F.when(changed, F.col(b)).otherwise(F.col(a))
    return x.select(F.coalesce("ok", "nk").alias(key), pick("ov", "nv").alias(version), pick("oval", "nval").alias(value), action.alias("action"))


def batch_limits(files: DataFrame, batch: str, most_files: int, most_bytes: int) -> DataFrame:
    """(batch, length) to one row for each batch: files, bytes, code. A batch over a limit is rejected whole."""
    x = files.groupBy(batch).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    return x.withColumn("code", F.when(F.col("files") > most_files, "TOO_MANY_FILES").when(F.col("bytes") > most_bytes, "BATCH_TOO_LARGE").otherwise("ACCEPTED"))


def json_records(lines: DataFrame, line: str, schema: str) -> DataFrame:
    """Lines of a log with the fields of the JSON object that starts at their first brace; lines without a whole one are left out."""
    raw = F.when(F.instr(line, "{") > 0, F.substr(F.col(line), F.instr(line, "{")))
    x = lines.withColumn("_r", F.from_json(raw, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return x.where("_r is not null and _r._bad is null").select(*[c for c in lines.columns if c != line], "_r.*").drop("_bad")
