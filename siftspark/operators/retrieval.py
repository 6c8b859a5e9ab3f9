"""Sparse and dense candidates of each query, best first."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Technical names and the token each stands for.
IDENTITIES = {
    "techjavascript": ("JavaScript", "Java Script", "JS"), "techtypescript": ("TypeScript", "Type Script", "TS"), "techkubernetes": ("Kubernetes", "K8s"),
    "techpostgresql": ("PostgreSQL", "Postgres"), "technodejs": ("Node.js", "NodeJS", "Node JS"), "techreactjs": ("React.js", "ReactJS", "React"),
    "techcsharp": ("C#", "C Sharp", "CSharp"), "techcplusplus": ("C++", "CPP", "C Plus Plus"), "techdotnet": (".NET", "dotnet", "dot net"),
    "techaws": ("Amazon Web Services", "AWS"), "techgcp": ("Google Cloud Platform", "GCP"),
}
PRIORITIES = ("required", "preferred", "context")


#: Fixed value: what may stand, or be missing, between the parts of a name.
JOINT = r"[\s._-]*"


def loose(name: str) -> str:
    """Pattern of a name as a whole word, whatever joins its parts; its first character counts as it is, a dot too."""
    rest = re.sub(r"(?:\\?[\s._-])+", lambda _: JOINT, re.escape(name[1:]))
    return rf"(?<!\w){re.escape(name[:1])}{rest}(?!\w)"


#: The lexical form, longer names first: patterns of case-folded names and the token for each.
REWRITES = [(loose(name.casefold()), token) for name, token in sorted(((n, t) for t, names in IDENTITIES.items() for n in names), key=lambda p: -len(p[0]))]


#: Whether a case-folded text may hold a name at all: most hold none, and skip the rewriting. Looser than the names' own patterns, and tried only where a name's first letter begins a word.
_NAMES = "(?<![a-z0-9_])(?=[{}])(?:{})(?![a-z0-9_])".format(
    "".join(sorted({n[0].casefold() for names in IDENTITIES.values() for n in names})), "|".join(p.removeprefix(r"(?<!\w)").removesuffix(r"(?!\w)") for p, _ in REWRITES)
)


def _folded(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC").str.casefold()


@F.arrow_udf(StringType())
def _folded_rows(text: pa.Array) -> pa.Array:
    # value by value: a batch of whole texts is held once as it came and once as it goes
    return pa.array((None if (t := v.as_py()) is None else unicodedata.normalize("NFKC", t).casefold() for v in text), pa.string(), size=len(text))


#: A character beyond ASCII that Spark's own lower case may not fold: all but Latin-1's letters (composed; all but ß fold to their lower case), dashes and quotation marks. What may be one is looked at only where a character is not ASCII.
_OTHER = r"[^\x00-\x7F](?<![\u00C0-\u00FF\u2013\u2014\u2018-\u201D])"


def beyond_latin(text: Column) -> Column:
    """Whether a text holds a character that only Python folds."""
    return (F.octet_length(text) != F.length(text)) & text.rlike(_OTHER)


def folded(text: Column) -> Column:
    """Compatibility composition and case folding. Spark has no function for it beyond Latin letters, so only texts with other characters go to Python."""
    return F.coalesce(_folded_rows(F.when(beyond_latin(text), text)), F.replace(F.lower(text), F.lit("ß"), F.lit("ss")))


def lexical(text: Column) -> Column:
    """Words between blanks, each technical name as one token; the same again when applied to its own result."""

    def rewritten(x: Column) -> Column:
        y = x
        for pattern, token in REWRITES:
            y = F.regexp_replace(y, f"(?U){pattern}", token)
        return F.when(x.rlike(_NAMES), y).otherwise(x)

    # the fold is made once: bound to a name in an array, it isn't repeated for each pattern
    once = F.transform(F.array(folded(text)), rewritten)
    return F.trim(F.regexp_replace(F.element_at(once, 1), r"[^\p{L}\p{N}]+", " "))


def lexical_terms(terms: list[str]) -> list[str]:
    """lexical() for the terms of a profile or query, on the driver: a bounded vocabulary."""
    x = _folded(pd.Series(terms, dtype="object"))
    for pattern, token in REWRITES:
        x = x.str.replace(pattern, token, regex=True)
    return x.str.findall(r"[^\W_]+").str.join(" ").tolist()


def sparse_top(texts: DataFrame, concepts: list[tuple[str, str, tuple[str, ...]]], k: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id, lexical) ranked by the concepts (name, priority, phrases) found: by required, preferred, context hits, then id.

    A concept counts once however often its phrases occur; texts without any concept have no row.
    """
    padded = F.concat(F.lit(" "), "lexical", F.lit(" "))

    def hits(priority: str) -> Column:
        found = [F.greatest(*[F.contains(padded, F.lit(f" {p} ")).cast("int") for p in (phrases[0], *phrases)]) for _, kind, phrases in concepts if kind == priority]
        return sum(found[1:], found[0]) if found else F.lit(0)

    x = texts.withColumns({p: hits(p) for p in PRIORITIES}).where("required + preferred + context > 0")
    w = Window.partitionBy(*keys).orderBy(*[F.desc(p) for p in PRIORITIES], "id") if keys else None
    if w is None:
        return x.orderBy(*[F.desc(p) for p in PRIORITIES], "id").limit(k)
    return x.withColumn("sparse_rank", F.row_number().over(w)).where(F.col("sparse_rank") <= k)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def cosine_to(a: Column, norm_a: Column, b: Column, norm_b: Column) -> Column:
    """Cosine in double precision of vectors whose norms are known; 0 for unequal lengths and zero vectors."""
    size = norm_a * norm_b
    return F.when((F.size(a) == F.size(b)) & (size > 0), _dot(a, b) / size).otherwise(0.0)


def dense_top(vectors: DataFrame, queries: DataFrame, key: str, k: int = 10) -> DataFrame:
    """(key, id, v) ranked for the one query (key, q) of each key by cosine of four places, then id. Exact: every vector of a key is scored."""
    q = queries.withColumn("_qn", norm(F.col("q")))
    x = vectors.withColumn("_n", norm(F.col("v"))).join(q, key)
    x = x.select(key, "id", F.round(cosine_to(F.col("v"), F.col("_n"), F.col("q"), F.col("_qn")), 4).alias("score"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    return x.withColumn("dense_rank", F.row_number().over(w)).where(F.col("dense_rank") <= k)


def encode(texts: DataFrame, encoder: Callable[[], Callable[[pd.Series], np.ndarray]]) -> DataFrame:
    """(id, text) to (id, vector). encoder() loads a model once for each task; the model maps a batch of texts to a matrix. Null texts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "vector": list(model(b["text"].fillna("")).astype(float))})

    return texts.select(F.col("id").cast("long"), "text").mapInPandas(run, "id long, vector array<double>")


def reuse(wanted: DataFrame, cached: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (id, hash) with action: CACHED where the id has a vector, REUSED where the same content has one, else COMPUTE."""
    c, k = cached.select("id").distinct().withColumn("_c", F.lit(True)), known.select("hash").distinct().withColumn("_k", F.lit(True))
    action = F.when(F.col("_c"), "CACHED").when(F.col("_k"), "REUSED").otherwise("COMPUTE")
    return wanted.join(c, "id", "left").join(k, "hash", "left").withColumn("action", action).drop("_c", "_k")


def rerank(candidates: DataFrame, score: Column, keys: list[str], rank: str, top: int = 2) -> DataFrame:
    """The best of each query by score (four places), ties in the order of rank."""
    x = candidates.withColumn("score", F.round(score, 4))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), rank)
    return x.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def pair_scorer(loader: Callable[[], Callable[[pd.Series, pd.Series], pd.Series]]):
    """A column function of (query, text) from a model that loader() loads once for each task and that scores batches."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = loader()
        for queries, texts in batches:
            yield model(queries.fillna(""), texts.fillna(""))

    return score


def query_actions(queries: DataFrame, cached: DataFrame, model: str, version: str) -> DataFrame:
    """Distinct queries (job, category, query) with hash and action: CACHED where a vector of their hash, model and version is known, else COMPUTE."""
    q = queries.select("job", "category", "query").distinct().withColumn("hash", F.sha2("query", 256))
    c = cached.where((F.col("model") == model) & (F.col("version") == version)).select("job", "category", "hash").distinct().withColumn("_c", F.lit(True))
    return q.join(c, ["job", "category", "hash"], "left").withColumn("action", F.when(F.col("_c"), "CACHED").otherwise("COMPUTE")).drop("_c")
