"""Passages that stand in other texts at word boundaries, found by their rarest word: no pair is looked at that does not share it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word, or one character that is neither part of a word nor white space: a text held at word boundaries has its own such parts in a row.
PARTS = r"(?U)\w+|[^\w\s]"
#: Fixed value: the mark of a section at the start of a chunk.
MARK = r"^\s*\[Section: [^\]]+\]\s*"


def plain(text: Column) -> Column:
    """Text without the mark of its section, runs of white space as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, MARK, ""), r"(?U)\s+", " "))


def parts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PARTS), F.lit(0))


def at_words(source: Column, passage: Column) -> Column:
    """Whether the source holds the passage with no word character right before or after it."""
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(passage, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?!\w)"))
    return F.contains(source, passage) & F.rlike(source, quoted)


def held(passages: DataFrame, full: DataFrame, cut: Callable[[Column], Column] = parts, matches: Callable[[Column, Column], Column] = at_words) -> DataFrame:
    """The distinct (k, own, text) of passages that a row of full (k, own, text) with the same k and another own holds; null own: every row counts.

    cut gives the words of a text, matches decides. A passage with a word that no full text of its k has is out at once; any other meets
    only the full texts with the word of it that the fewest of them have. Null texts and texts without words hold nothing and are not held.
    A word with its k, and a full text with its k, are shuffled as 64-bit hashes: equal hashes only make more pairs, which the texts, keys and owners themselves decide.
    While its rarest word is sought, a passage is known by 128 bits.
    """
    word = lambda df: df.select("*", F.explode(F.array_distinct(cut(F.col("text")))).alias("word")).withColumn("word", F.xxhash64("k", "word"))
    owns = (F.min("own").alias("_low"), F.max("own").alias("_high"), F.bool_or(F.col("own").isNull()).alias("_any"))
    other = F.col("own").isNull() | F.col("_any") | (F.col("_low") != F.col("own")) | (F.col("_high") != F.col("own"))
    f = full.where("text is not null").groupBy("k", "text").agg(*owns).withColumn("_f", F.xxhash64("k", "text"))
    ids = F.struct(F.xxhash64("k", "own", "text").alias("a"), F.xxhash64("text", "own", "k").alias("b"))
    p = passages.select("k", "own", "text").where("text is not null").distinct().withColumn("_p", ids)
    postings = word(f).select("word", "_f", "_low", "_high", "_any")
    counts = postings.groupBy("word").agg(F.count("*").alias("_c"))
    rare = word(p).select("_p", "word").join(counts, "word", "left").groupBy("_p").agg(F.bool_and(F.col("_c").isNotNull()).alias("_known"), F.min(F.struct("_c", "word")).alias("_r"))
    rare = p.join(rare.where("_known").select("_p", F.col("_r.word").alias("word")), "_p").select("k", "own", "text", "word")
    pairs = rare.join(postings, "word").where(other).select("k", "own", "text", "_f")
    whole = f.select("_f", F.col("k").alias("_k"), F.col("text").alias("_full"), "_low", "_high", "_any")
    return pairs.join(whole, "_f").where((F.col("k") == F.col("_k")) & other & matches(F.col("_full"), F.col("text"))).select("k", "own", "text").distinct()


def keyed(df: DataFrame, keys: list[str], text: Column, own: str | None = None) -> DataFrame:
    """df with k, own and text as held() takes them; rows with null keys belong together."""
    return df.select("*", F.struct(F.lit(1).alias("one"), *keys).alias("_k"), F.col(own).alias("_own_") if own else F.lit(None).cast("int").alias("_own_"), text.alias("_text"))


def _slim(df: DataFrame) -> DataFrame:
    return df.select(F.col("_k").alias("k"), F.col("_own_").alias("own"), F.col("_text").alias("text"))


def not_held(retrieved: DataFrame, full: DataFrame, keys: list[str], own: str | None, text: Callable[[Column], Column], cut: Callable, matches: Callable) -> DataFrame:
    """Rows of retrieved (keys, own, text) that no row of full holds, duplicates and columns as they are."""
    r, f = (keyed(df, keys, text(F.col("text")), own) for df in (retrieved, full))
    h = held(_slim(r), _slim(f), cut, matches)
    on = (F.col("_k") == h.k) & F.col("_own_").eqNullSafe(h.own) & (F.col("_text") == h.text)
    return r.join(h, on, "left_anti").drop("_k", "_own_", "_text")


def kept_sentences(retrieved: DataFrame, full: DataFrame) -> DataFrame:
    """Retrieved sentences (pair_id, row, category, source_category, text) to pair_id, row, kept.

    A row is one sentence under each of its categories. It goes if each of them finds it, at word boundaries, in a sentence of full (pair_id,
    category, source_category, text) of the same pair, category and source category; sentences of full never go. Blank ones stay.
    """
    keys = ["pair_id", "category", "source_category"]
    r, f = keyed(retrieved, keys, plain(F.col("text"))), keyed(full, keys, plain(F.col("text")))
    h = held(_slim(r), _slim(f)).select("k", F.col("text").alias("_t"), F.lit(True).alias("_held"))
    x = r.join(h, (F.col("_k") == F.col("k")) & (F.col("_text") == F.col("_t")), "left")
    return x.groupBy("pair_id", "row").agg((~F.bool_and(F.coalesce("_held", F.lit(False)))).alias("kept"))
