"""The training-data operators against brute force, on small made-up rows and on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftspark.llm import copies, lines, mixing, packing, repeats, simhash, url_filter, vectors
from siftspark.llm.common import Scratch, components
from siftspark.llm.queries import ORACLE_SQL, QUERIES, every_20th, vocabulary

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, size int, key string"
LONG = " ".join(f"w{i}x" for i in range(6000))
ODD = [
    (1, None, "a", 1, "k"), (2, "", None, 1, "k"), (3, " \n\t\n", "b", 1, "k"), (4, LONG, "b", 1, "k"), (5, LONG, "b", 1, "k"), (6, LONG[:3000] + " y " + LONG[3000:], "c", 1, "k"),
    (7, "one two three four five\none two three four five\nsix", None, None, None), (7, "one two three four five\none two three four five\nsix", None, None, None),
    (None, "one two three four five", "a", 1, "k"), (8, "naïve 漢字 ß don't \x01 <|endoftext|> \xa0x", "d", 1, "k"), (9, "ab" * 900, "d", 1, "k"), (10, "é" * 500, "d", 1, "k"),
]


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return docs(spark, [])


def given(spark, table):
    return spark.read.parquet(f"{DATA}/{table}.parquet")


def fp(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("limit", [4, 8192])
def test_near_links_of_bits(spark, limit):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 62, 30)
    fps = sorted({int(b) ^ sum(1 << int(i) for i in r.choice(63, r.integers(0, 4), False)) for b in base for _ in range(6)})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    cc = components(simhash.near_links(frame, Scratch(spark), limit=limit), Scratch(spark))
    got = {f: f for f in fps} | {x.node: x.component for x in cc.collect()}
    assert got == groups_of(fps, lambda a, b: (a ^ b).bit_count() <= 3)


def test_simhash_groups(spark):
    rows = [(r.doc_id, r.text) for r in given(spark, "documents").select("doc_id", "text").collect()]
    f = {i: fp(t) for i, t in rows}
    want = groups_of([i for i, _ in rows], lambda a, b: (f[a] ^ f[b]).bit_count() <= 3)
    got = {r.doc_id: r for r in QUERIES["op7_simhash_near_dedup"](spark, DATA).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.fingerprint == f"{f[i]:016x}" for i, r in got.items())


def test_simhash_odd_rows(spark):
    got = simhash.near_groups(docs(spark), Scratch(spark)).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert simhash.near_groups(empty(spark), Scratch(spark)).count() == 0
    kept = simhash.one_of_each(docs(spark), Scratch(spark)).collect()
    assert Counter(r.doc_id for r in kept)[7] == 1 and Counter(r.doc_id for r in kept)[5] == 0


def brute_lines(rows, similarity=0.8):
    seen, out = [], {}
    for i, t in rows:
        gone = []
        for k, line in enumerate((t or "").encode().split(b"\n")):
            s = frozenset(line.lower().split())
            if s and any(len(s & o) >= similarity * len(s | o) - 1e-9 for o in seen):
                gone.append(k)
            if s:
                seen.append(s)
        out[i] = gone
    return out


@pytest.mark.parametrize(("limit", "many", "sent"), [(8192, 16, 1 << 17), (8, 0, 1 << 17), (8192, 0, 0)])
def test_line_dedup(spark, monkeypatch, limit, many, sent):
    monkeypatch.setattr(lines, "MANY", many)
    monkeypatch.setattr(lines, "FIRST", 1 if sent == 0 else lines.FIRST)
    monkeypatch.setattr(lines, "WORDS_SENT", sent)
    r = np.random.default_rng(2)
    words = [f"v{i}" for i in range(60)]
    make = lambda: " ".join(r.choice(words, r.integers(2, 14)))
    base = [make() for _ in range(40)]
    rows = [(i, "\n".join(" ".join(w if r.random() > 0.05 else "z" for w in base[r.integers(40)].split()) for _ in range(3))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.later for x in lines.later_lines(frame, Scratch(spark), limit=limit).collect()}
    assert {i: got.get(i, []) for i, _ in rows} == brute_lines(rows)


def test_lines_of_many_near_copies(spark):
    """One near-copy group of two thousand lines, whose words are common: all but the first go, by few verified pairs."""
    r = np.random.default_rng(8)
    base = [f"word{i}" for i in range(20)]
    rows = [(i, " ".join([*base[: (k := int(r.integers(0, 20)))], f"own{i}", *base[k + 1 :]])) for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id for x in lines.later_lines(frame, Scratch(spark)).collect()}
    sets, want = [set(t.split()) for _, t in rows], set()
    for i in range(1, 2000):
        if any(len(sets[i] & s) >= 0.8 * len(sets[i] | s) - 1e-9 for s in sets[:i]):
            want.add(i)
    assert got == want and len(want) > 1900


def test_line_dedup_odd_rows(spark):
    out = lines.without_later_lines(docs(spark), Scratch(spark))
    assert out.columns == docs(spark).columns and out.count() == len(ODD)
    assert {r.doc_id: r.text for r in out.where("doc_id = 7").collect()} == {7: "six"}
    assert lines.without_later_lines(empty(spark), Scratch(spark)).count() == 0


def brute_repeats(raws, w):
    seen = Counter(r[p : p + w] for r in raws for p in range(len(r) - w + 1))
    for raw in raws:
        mark = np.zeros(len(raw), bool)
        for p in range(len(raw) - w + 1):
            if seen[raw[p : p + w]] > 1:
                mark[p : p + w] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~mark])
        yield len(raw), int(mark.sum()), int((np.diff(np.concatenate([[0], mark])) > 0).sum()), hashlib.sha256(kept).hexdigest()


def test_repeats(spark):
    rows = [(r.doc_id, r.text) for r in given(spark, "documents").select("doc_id", "text").collect()] + [(10_000 + n, x[1]) for n, x in enumerate(ODD) if x[1] != LONG]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    cut = repeats.cut_repeats(frame, Scratch(spark)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    got = {r[0]: tuple(r[1:]) for r in cut.collect()}
    assert got == dict(zip((i for i, _ in rows), brute_repeats([(t or "").encode() for _, t in rows], 400), strict=True))
    assert repeats.cut_repeats(empty(spark), Scratch(spark)).count() == 0


def check_packed(rows, texts, limit):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:], strict=False)) and sum(p[-1]) <= limit
    want = Counter()
    for i, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.update((i, k, a, len(ids[a : a + limit]), zlib.crc32(np.array(ids[a : a + limit], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), limit)))
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    return len(places)


def test_packing(spark):
    rows = packing.pack(docs(spark), Scratch(spark), vocabulary()).collect()
    check_packed(rows, [(r[0], r[1]) for r in ODD], 4096)
    some = given(spark, "documents").limit(60)
    texts = [(r.doc_id, r.text) for r in some.collect()]
    n = check_packed(packing.pack(some, Scratch(spark), vocabulary(), 1024).collect(), texts, 1024)
    total = sum(r.length for r in packing.pieces(some, vocabulary(), 1024).collect())
    assert n <= 1.1 * total / 1024 + 2
    assert packing.pack(empty(spark), Scratch(spark), vocabulary()).count() == 0


def test_exact_search_beyond_doubles_and_odd_vectors(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, -1.0]), (20, [0.5, 0.5]), (21, None), (22, [float("nan"), 1.0]), (23, [None, 1.0]), (24, [0.0, 0.0]), (25, [1.0]), (None, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in vectors.exact_top_k(v, every_20th(), 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 20, 2**63 - 1), (20, 1, 0, 2**63 - 1), (20, 2, 1, 2**63 - 1)]
    assert {r.vec_id for r in vectors.near_top_k(v, every_20th(), 9).collect()} == {0, 1, 20}
    assert vectors.exact_top_k(v.limit(0), every_20th()).count() == 0


def test_nra_with_ties():
    r = np.random.default_rng(5)
    x = r.integers(-3, 4, (400, 5)) / 64
    ids = np.arange(400)
    rows, at, s = vectors.nra(ids[:30], x[:30], ids, x, 7)
    whole = np.floor(x * 64).astype(int)
    for q in range(30):
        scores = whole @ whole[q]
        want = sorted((-scores[j], j) for j in range(400) if j != q)[:7]
        assert [(-a, b) for a, b in zip(s[rows == q], at[rows == q], strict=True)] == want


def test_recall_of_near_search(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, float) for r in e.collect()}
    ids = np.array(sorted(x))
    m = np.array([x[i] for i in ids])
    hit = total = 0
    found = defaultdict(set)
    for r in vectors.near_top_k(e, every_20th()).collect():
        found[r.query_id].add(r.vec_id)
    for q in found:
        s = m @ x[q]
        s[ids == q] = -np.inf
        hit, total = hit + len(found[q] & set(ids[np.argsort(-s)[:20]].tolist())), total + 20
    assert hit / total >= 0.9


def test_quality_held_out(spark):
    got = {r.doc_id: r for r in QUERIES["op3_quality_classifier"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in labels)
    held = [r for r in labels if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].predicted == r.quality for r in held) >= 0.9 * len(held)


def test_mix_odd_rows(spark):
    rows = mixing.mix(docs(spark), Scratch(spark)).collect()
    assert len(rows) == len(ODD) and all(r.taken <= 3 * r["size"] for r in rows)
    by = defaultdict(int)
    for r in rows:
        by[r.source] += r.taken
    assert all(abs(by[r.source] - r.target) <= 1 for r in rows)
    assert mixing.mix(empty(spark), Scratch(spark)).count() == 0
    assert mixing.mixed_documents(docs(spark), Scratch(spark)).columns == docs(spark).columns


def test_mix_ties_and_clashing_names(spark):
    rows = [(i % 3, "a b c", "s", i, "k") for i in range(9)] + [(1, "a b c", "t", 0, "k")] * 2
    frame = docs(spark, rows).withColumns({"target": F.lit(1), "taken": F.lit(2), "part": F.lit("x"), "source_size": F.lit(3), "_mix_id": F.lit(4)})
    got = mixing.mix(frame, Scratch(spark)).collect()
    again = mixing.mix(frame.repartition(5), Scratch(spark)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == 11
    assert {r.source: round(r.target, 6) for r in got} == {"s": 23.571429, "t": 9.428571}
    assert sum(r.taken for r in got if r.source == "s") == 24 and sum(r.taken for r in got if r.source == "t") == 9
    out = mixing.mixed_documents(frame, Scratch(spark))
    assert out.columns == frame.columns and {(r.target, r.taken, r.part, r.source_size, r["_mix_id"]) for r in out.collect()} == {(1, 2, "x", 3, 4)}


def test_private_names_are_never_taken(spark):
    rows = [(1, "one two three four five six\nalpha beta", "a", 1, "k"), (2, "one two three four five six\ngamma delta", "a", 2, "k"), (3, "one two three four five six\nalpha beta", "b", 3, "k"), (4, None, "b", 4, "k")]
    names = ["_th", "_k_doc", "_k_th", "_later", "_l_doc", "_L_TH", "_kept", "_mix_id", "_mix_times", "_mix_one", "th", "later"]
    frame = docs(spark, rows).withColumns({n: F.concat(F.lit(f"{n}-"), "doc_id") for n in names})
    for out in (copies.one_of_each(frame, Scratch(spark)), lines.without_later_lines(frame, Scratch(spark)), mixing.mixed_documents(frame, Scratch(spark))):
        found = out.collect()
        assert out.columns == frame.columns and found and all(r[n] == f"{n}-{r.doc_id}" for r in found for n in names)


def test_url_odd_rows(spark):
    schema = "page_id long, url string, html string, host string, verdict int"
    assert url_filter.judge(spark.createDataFrame([], schema), Scratch(spark)).count() == 0
    long = "http://x.net/" + "a" * 100_000
    rows = [(1, "http://Example.NET/en/x?y#z", None, "h", 1), (1, "http://Example.NET/en/x?y#z", None, "h", 1), (2, long, "", "h", 1), (3, "a://example.com/de", "", "h", 1), (None, "b://u:p@sub.example.com/de/", "", "h", 1)]
    got = sorted((r.page_id or 0, r.host, len(r.path), r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, schema), Scratch(spark)).collect())
    assert got == [(0, "u:p@sub.example.com", 4, "example.com/de/", "block"), (1, "example.net", 5, "example.net/en/", "allow"), (1, "example.net", 5, "example.net/en/", "allow"), (2, "x.net", 100_001, "net/", "block"), (3, "example.com", 3, None, "allow")]


def test_url_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.test/x", link.format("http://b.net/y")), (2, "http://c.test/z#top", '<meta http-equiv="refresh" content="0; url=http://a.test/x">'), (3, "HTTP://B.net/y?q", None),
        (4, "http://d.test/", link.format("/e")), (5, "http://d.test/e", ""), (6, None, None), (7, "no address", "x"), (8, "http://f.org/fr/1", link.format("http://g.net/")), (9, "http://h.test/", link.format("http://f.org/fr/1")),
    ]
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), Scratch(spark)).collect()}
    assert got[1][2] == "block" and got[2][2] == "block" and got[3] == ("b.net", "net/", "block") and got[4][2] == got[5][2] == "allow"
    assert got[6] == ("", None, "allow") and got[7] == ("", None, "allow") and got[8][1:] == ("org/fr/", "allow") and got[9][2] == "allow"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rel, df = con.sql(ORACLE_SQL[name]), QUERIES[name](spark, DATA)
    cols = sorted(rel.columns)
    assert cols == sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(repr([plain(x) for x in r]) for r in rel.project(", ".join(cols)).fetchall())
    assert want == sorted(repr([plain(x) for x in r]) for r in df.select(*cols).collect())
