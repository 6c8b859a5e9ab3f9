"""Language ID against the same sums in plain Python, on pages whose language is not what their markup says."""

import math
import re
from collections import Counter, defaultdict

import numpy as np

from siftspark.llm import langid
from siftspark.llm.common import Scratch

DOCS = [(1, "the cat and the dog went to the house by the sea", "en"), (2, "der hund und die katze gingen in das haus am meer", "de"), (3, "le chat et le chien sont dans la maison", "fr"), (4, None, "fr"), (5, "no language", None)]
TEXTS = {"en": "the dog and the cat by the house", "de": "die katze und der hund am haus", "fr": "la maison et le chat"}
PAGES = [
    (1, "http://a.de/x", f"<html lang='de'><script>var the</script>{TEXTS['de']}</html>"), (2, "http://a.de/y", f"<html lang='en'>{TEXTS['de']}</html>"), (3, "http://b.fr/", f"<html lang='en'>{TEXTS['en']}</html>"),
    (4, "http://www.b.fr/z", f"<html>{TEXTS['fr']}</html>"), (5, None, None), (6, "http://a.de/x", ""), (7, "http://c.com/", "<html lang=fr>" + TEXTS["fr"] + " &amp; " + "le chien " * 400 + "</html>"), (7, "http://c.com/", "x"),
]


def brute(pages, docs, weight=300.0, strength=5.0, alpha=1.0):
    sums = defaultdict(lambda: np.zeros(langid.GRAMS))
    for _, text, lang in docs:
        if text is not None and lang is not None:
            sums[lang] += langid.gram_counts(text)
    langs = sorted(sums)
    logs = {g: np.log((c + 0.5) / (c.sum() + 0.5 * langid.GRAMS)).astype(np.float32) for g, c in sums.items()}
    rows = []
    for _, url, page in pages:
        c = langid.gram_counts(langid.page_text(page))
        n = c.sum()
        ll = [float(logs[g] @ c) * min(n, weight) / n if n else 0.0 for g in langs]
        e = [math.exp(v - max(ll)) for v in ll]
        host = (re.search(r"://([^/?#]*)", url or "") or [None, ""])[1].lower()
        declared = re.search(r"<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", page or "")
        rows.append({"ll": ll, "p": [v / sum(e) for v in e], "host": host, "declared": declared[1].lower() if declared else "", "suffix": host.split(".")[-1], "domain": ".".join(host.split(".")[-2:])})
    total = [sum(r["p"][k] for r in rows) for k in range(len(langs))]
    whole = [(t + alpha) / (len(rows) + alpha * len(langs)) for t in total]
    by = {name: defaultdict(lambda: [0.0] * len(langs)) for name in ("declared", "suffix", "domain", "host")}
    n = {name: Counter(r[name] for r in rows) for name in by}
    for r in rows:
        for name, values in by.items():
            values[r[name]] = [a + b for a, b in zip(values[r[name]], r["p"], strict=True)]
    for r in rows:
        out = []
        for k in range(len(langs)):
            s = r["ll"][k] + sum(math.log((by[name][r[name]][k] + alpha) / (total[k] + alpha * len(by[name]))) for name in ("declared", "suffix"))
            domain = (by["domain"][r["domain"]][k] - r["p"][k] + strength * whole[k]) / (n["domain"][r["domain"]] - 1 + strength)
            host = (by["host"][r["host"]][k] - r["p"][k] + strength * domain) / (n["host"][r["host"]] - 1 + strength)
            out.append(s + math.log(max(host, 1e-12)))
        e = [math.exp(v - max(out)) for v in out]
        yield langs[out.index(max(out))], round(max(e) / sum(e), 5)


def test_equals_plain_sums(spark):
    p = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    d = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    got = sorted((r.page_id, r.lang, round(r.confidence, 5)) for r in langid.identify(p, d, Scratch(spark)).collect())
    assert got == sorted((page[0], *x) for page, x in zip(PAGES, brute(PAGES, DOCS), strict=True))
    assert {i: g for i, g, _ in got}[2] == "de"  # the text outweighs its declared language


def test_no_pages_extra_columns_and_long_texts(spark):
    d = spark.createDataFrame(DOCS, "doc_id long, text string, lang string")
    assert langid.identify(spark.createDataFrame([], "page_id long, url string, html string"), d, Scratch(spark)).count() == 0
    rows = [(1, "http://a.de/", "<p>" + "der hund " * 300_000, "x", 1), (1, "http://a.de/", "<p>" + "der hund " * 300_000, "x", 1)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, lang string, host int")
    assert [r.lang for r in langid.identify(p, d, Scratch(spark)).collect()] == ["de", "de"]
