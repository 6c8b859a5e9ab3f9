"""Quality and safety measures of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions.text import zero_width_count

#: Phrases that try to override instructions, and tags that only the system may write.
OVERRIDES = (r"(?i)ignore (all|any|previous|prior) ", r"(?i)disregard (all|any|previous|prior) ", r"(?i)you are now ", r"(?i)system prompt")
RESERVED = r"(?i)</?(candidate_data|job_data|system)>"
HIDDEN = 5


def injection_reasons(rows: DataFrame) -> DataFrame:
    """Adds reasons: OVERRIDE, RESERVED_TAG and HIDDEN_TEXT, those that hold, in this order."""
    override = F.lit(False)
    for p in OVERRIDES:
        override = override | F.col("text").rlike(p)
    reasons = F.array(
        F.when(override, "OVERRIDE"), F.when(F.col("text").rlike(RESERVED), "RESERVED_TAG"), F.when(zero_width_count(F.col("text")) > HIDDEN, "HIDDEN_TEXT")
    )
    return rows.withColumn("reasons", F.array_join(F.array_compact(reasons), ","))
