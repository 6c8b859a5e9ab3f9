"""Column functions on texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: The mail pattern and its mask.
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
MAIL_MASK = "[REDACTED_EMAIL]"
#: Code points of no width.
ZERO_WIDTH = "​‌‍⁠﻿"


def mask_mail(text: Column) -> Column:
    return F.regexp_replace(text, MAIL, MAIL_MASK)


def escape_xml(text: Column) -> Column:
    """Text that can stand inside a boundary tag; & goes first."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def zero_width_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, ZERO_WIDTH, ""))


def spreadsheet_safe(text: Column) -> Column:
    """Cells that a spreadsheet would read as a formula get a leading quote."""
    return F.when(F.ltrim(text).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def excerpt(text: Column, needle: Column, before: int = 80, after: int = 180) -> Column:
    """Text around the first hit of needle (any case), null without one."""
    at = F.instr(F.lower(text), F.lower(needle))
    return F.when(at > 0, F.substr(text, F.greatest(at - before, F.lit(1)), at + after - F.greatest(at - before, F.lit(1))))


@F.pandas_udf(DoubleType())
def _entropy(text: pd.Series) -> pd.Series:
    def of(t: str) -> float:
        p = np.unique(np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32), return_counts=True)[1] / len(t)
        return float(-(p * np.log2(p)).sum())

    return pd.Series([of(t) if t else 0.0 for t in text], dtype="float64")


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, case-sensitive, 2 places; empty and null texts have 0. Characters are counted in one pass over a text, in Arrow batches."""
    return F.round(_entropy(F.coalesce(text, F.lit(""))), 2) + 0.0
