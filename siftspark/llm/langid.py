"""Language ID of web pages: text likelihoods fused with declared language, address suffix and host priors."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import batch_of
from .common import Scratch
from .url_filter import host_of

#: Hashed byte trigrams of the text model.
GRAMS = 1 << 14
BYTES_AT_ONCE = 1 << 20
_SKIP = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_DECLARED = r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)"


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed trigrams of the text's lower-cased UTF-8 bytes."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    out = np.zeros(GRAMS, np.int64)
    for s in range(0, max(0, len(raw) - 2), BYTES_AT_ONCE):
        x = raw[s : s + BYTES_AT_ONCE + 2].astype(np.uint32)
        x = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        out += np.bincount((x * np.uint32(2654435761)) >> np.uint32(18), minlength=GRAMS)
    return out


def page_text(page: str | None) -> str:
    return html.unescape(_SKIP.sub(" ", page or ""))


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and, for each, the smoothed log shares of the hashed trigrams of all its documents.

    Each task adds up its own counts; only the model, of fixed size for a language, reaches the driver.
    """
    schema = pa.schema([("lang", pa.string()), ("counts", pa.binary())])

    def rows(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        return batch_of(schema, list(sums), [v.astype("<i8").tobytes() for v in sums.values()])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = gram_counts(text.as_py())
                sums[lang] = sums[lang] + c if lang in sums else c
        yield rows(sums)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = np.frombuffer(raw, "<i8")
                sums[lang] = sums[lang] + c if lang in sums else c.copy()
        yield rows(sums)

    kind = "lang string, counts binary"
    parts = docs.where("lang is not null and text is not null").select("lang", F.col("text").cast("string")).mapInArrow(count, kind)
    got = sorted((r.lang, np.frombuffer(bytes(r.counts), "<i8")) for r in parts.repartition("lang").mapInArrow(total, kind).collect())
    model = np.array([np.log((c + 0.5) / (c.sum() + 0.5 * GRAMS)) for _, c in got]).reshape(len(got), GRAMS)
    return [lang for lang, _ in got], model.astype(np.float32)


def _softmax(x: list[Column]) -> list[Column]:
    top = F.greatest(*x) if len(x) > 1 else x[0]
    e = [F.exp(c - top) for c in x]
    return [c / reduce(add, e) for c in e]


def identify(pages: DataFrame, docs: DataFrame, scratch: Scratch, weight: float = 300.0, strength: float = 5.0, alpha: float = 1.0) -> DataFrame:
    """The language of each page (page_id, url, html): page_id, lang, confidence, text_lang, declared, host.

    log p(lang) sums four kinds of evidence: the mean log likelihood of the text's trigrams, counted
    as weight trigrams (fewer, if the text is shorter), under models of all documents by language; the
    declared markup language and the address's suffix, by their smoothed shares for each language;
    and the host's prior, smoothed by its domain's, which is smoothed by that of all pages. Shares
    and priors are sums of the text's posterior over pages, grouped by value; a page's own is left
    out of its host's. Null or empty html is evidence of nothing; null addresses share the host ''.
    Repeated rows count each. Without any labelled documents lang and confidence are null.
    """
    langs, model = text_model(docs)
    p = pages.select("page_id", "html", host_of(F.col("url")).alias("host"))
    p = p.withColumn("declared", F.lower(F.coalesce(F.regexp_extract("html", _DECLARED, 1), F.lit(""))))
    if not langs:
        none = F.lit(None).cast("string")
        return p.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("confidence"), none.alias("text_lang"), "declared", "host")
    shared = scratch.spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lls = np.zeros((b.num_rows, len(langs)))
            for k, page in enumerate(b.column(b.num_columns - 1)):
                c = gram_counts(page_text(page.as_py()))
                if n := c.sum():
                    used = np.flatnonzero(c)
                    lls[k] = shared.value[:, used] @ c[used] * (min(n, weight) / n)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x) for x in lls.T)], names=[*b.schema.names[:-1], *(f"l{k}" for k in range(len(langs)))])

    keep = p.select("page_id", "host", "declared").dtypes
    schema = ", ".join(f"{c} {t}" for c, t in keep) + "".join(f", l{k} double" for k in range(len(langs)))
    x = scratch.save(p.select("page_id", "host", "declared", "html").mapInArrow(run, schema), "lang-text")
    each = range(len(langs))
    ll, post = [F.col(f"l{k}") for k in each], [F.col(f"p{k}") for k in each]
    x = x.select("*", *[q.alias(f"p{k}") for k, q in enumerate(_softmax(ll))])
    x = x.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2))
    total = x.agg(F.count("*").alias("n"), *[F.sum(q).alias(f"t{k}") for k, q in enumerate(post)]).first()
    if not total.n:
        return x.select("page_id", F.lit("").alias("lang"), F.lit(0.0).alias("confidence"), F.lit("").alias("text_lang"), "declared", "host")
    whole = [(total[f"t{k}"] + alpha) / (total.n + alpha * len(langs)) for k in each]
    score = ll
    for name in ("declared", "suffix"):
        sums = x.groupBy(F.col(name).alias(f"k_{name}")).agg(*[F.sum(q).alias(f"{name}{k}") for k, q in enumerate(post)])
        values = sums.count()
        x = x.join(sums, F.col(name) == F.col(f"k_{name}"))
        score = [s + F.log((F.col(f"{name}{k}") + alpha) / (total[f"t{k}"] + alpha * values)) for k, s in enumerate(score)]
    for name in ("domain", "host"):
        sums = x.groupBy(F.col(name).alias(f"k_{name}")).agg(F.count("*").alias(f"n_{name}"), *[F.sum(q).alias(f"{name}{k}") for k, q in enumerate(post)])
        x = x.join(sums, F.col(name) == F.col(f"k_{name}"))
    domain = [(F.col(f"domain{k}") - post[k] + strength * whole[k]) / (F.col("n_domain") - 1 + strength) for k in each]
    host = [(F.col(f"host{k}") - post[k] + strength * domain[k]) / (F.col("n_host") - 1 + strength) for k in each]
    final = _softmax([s + F.log(F.greatest(h, F.lit(1e-12))) for s, h in zip(score, host, strict=True)])
    x = x.select("page_id", "host", "declared", *[q.alias(f"f{k}") for k, q in enumerate(final)], *post)

    def best(cols: list[Column]) -> Column:
        top, out = F.greatest(*cols) if len(cols) > 1 else cols[0], F.lit(langs[-1])
        for k in reversed(each):
            out = F.when(cols[k] == top, F.lit(langs[k])).otherwise(out)
        return out

    last = [F.col(f"f{k}") for k in each]
    return x.select("page_id", best(last).alias("lang"), (F.greatest(*last) if len(langs) > 1 else last[0]).alias("confidence"), best(post).alias("text_lang"), "declared", "host")
