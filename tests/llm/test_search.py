"""Both searches: that they stop before the lists or leaves end, what they find, ties, repeated rows and odd columns."""

import numpy as np
from pyspark.sql import functions as F

from siftspark.llm import vectors
from siftspark.llm.queries import every_20th


def unit(r, n, d=64):
    x = r.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clustered(r, n):
    x = unit(r, 40)[r.integers(0, 40, n)] + 0.2 * unit(r, n)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def varied(r, n):
    return unit(r, n) * np.exp(0.5 * r.standard_normal((n, 1)))


def searched(search, x, queries, k=20):
    vectors.WORK.update(all=0, read=0, projected=0, resolved=0)
    ids = np.arange(len(x))
    rows, at, s = search(ids[queries], x[queries], ids, x, k)
    return {(int(q), int(c)): v for q, c, v in zip(rows, at, s, strict=True)}, dict(vectors.WORK)


def brute(x, queries, k=20):
    s = x[queries] @ x.T
    s[np.arange(len(queries)), queries] = -np.inf
    return {(n, int(j)) for n in range(len(queries)) for j in np.lexsort((np.arange(len(x)), -s[n]))[:k]}


def test_lists_are_not_read_to_their_ends():
    r = np.random.default_rng(3)
    for x, most in ((unit(r, 4096), 0.85), (clustered(r, 4096), 0.4), (varied(r, 4096), 0.95)):
        queries = np.arange(0, 4096, 64)
        found, work = searched(vectors.nra, x, queries)
        assert set(found) == brute(np.floor(64 * x), queries)
        assert work["read"] <= most * work["all"] and work["resolved"] <= 0.15 * work["all"]


def test_bounds_hold_at_every_depth_and_come_from_read_entries_alone():
    r = np.random.default_rng(6)
    x, q = np.floor(64 * unit(r, 300, 9)), np.floor(64 * unit(r, 11, 9))
    q[0, 3] = 0
    both, lists = np.hstack([np.maximum(q, 0), np.minimum(q, 0)]), vectors._Lists(x)
    for depth in (1, 40, 170, 299, 300):
        lists.read_to(depth)
        rank = np.argsort(lists.order, axis=0)
        assert (lists.read[:, :9] == (rank >= 300 - depth)).all() and (lists.read[:, 9:] == (rank < depth)).all()
        assert not lists.seen[~lists.read].any()
        exact, own = q @ x.T, r.integers(0, 300, (11, 20))
        assert (lists.upper(both) >= exact).all() and (lists.lower(both, np.arange(300)) <= exact).all()
        assert (lists.lower(both, own) <= np.take_along_axis(exact, own, axis=1)).all()
    assert (lists.upper(both) == exact).all() and (lists.lower(both, np.arange(300)) == exact).all()


def test_not_all_leaves_are_opened_nor_all_they_hold_verified():
    r = np.random.default_rng(4)
    for x, opened, most in ((unit(r, 4096), 1.0, 0.75), (clustered(r, 4096), 0.3, 0.1), (varied(r, 4096), 0.95, 0.5)):
        queries = np.arange(0, 4096, 64)
        found, work = searched(vectors.projected, x, queries)
        assert len(set(found) & brute(x, queries)) >= 0.9 * 20 * len(queries)
        assert work["projected"] <= opened * work["all"] and work["resolved"] <= most * work["all"]
        assert all(abs(v - x[queries[q]] @ x[c]) < 1e-12 for (q, c), v in found.items())


def test_bands_cover_all_rows_and_huge_components_end():
    r = np.random.default_rng(8)
    lengths = np.exp(2 * r.standard_normal(5000))
    cut = vectors.bands(lengths)
    assert sorted(np.concatenate(cut)) == list(range(5000)) and all(len(b) >= 256 for b in cut[:-1])
    assert all(lengths[b].min() >= lengths[a].max() for a, b in zip(cut[1:], cut, strict=False))
    x = unit(r, 500, 8) * np.where(np.arange(500) % 50 == 0, 1e200, 1.0)[:, None]
    x[7], x[0] = 1.7e308, -1.7e308
    ids = np.arange(500)
    rows, at, _ = vectors.projected(ids[:40], x[:40], ids, x, 5)
    assert np.bincount(rows).tolist() == [5] * 40 and (rows != at).all()
    rows, at, s = vectors.nra(ids[:40], x[:40], ids, x, 5)
    for n in (1, 7, 39):
        whole = lambda v: [int(c) for c in np.clip(np.floor(np.minimum(v, 2.8e306) * 64), -1.7976931348623157e308, 1.7976931348623157e308)] if abs(v[0]) < 1e300 else [int(np.sign(v[0])) * int(np.finfo(float).max)] * 8
        scores = [(-sum(a * b for a, b in zip(whole(x[n]), whole(x[j]), strict=True)), j) for j in range(500) if j != n]
        assert at[rows == n].tolist() == [j for _, j in sorted(scores)[:5]]
    empty = np.empty((3, 0))
    assert vectors.nra(ids[:1], empty[:1], ids[:3], empty, 5)[1].tolist() == [1, 2]


def test_ranks_scores_repeated_rows_and_names(spark):
    rows = [(i, [float(i % 7), 1.0, -0.5 * (i % 3)], i) for i in range(60)] + [(3, [3.0, 1.0, 0.0], 3), (20, [6.0, 1.0, -1.0], 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").withColumns({"rank": F.lit(1), "q": F.lit(2), "qb": F.lit(3), "query_id": F.lit(4)})
    for search, of in ((vectors.exact_top_k, lambda a: np.floor(64 * np.array(a))), (vectors.near_top_k, np.array)):
        got = sorted((r.query_id, r["rank"], r.vec_id, float(r.score)) for r in search(v, every_20th(), 4).collect())
        counts = {}
        for q, rank, *_ in got:
            counts.setdefault(q, []).append(rank)
        assert set(counts) == {0, 20, 40} and all(ranks[:4] == sorted(ranks)[:4] for ranks in counts.values())
        own = {i: of(e) for i, e, _ in rows if i != 20}
        for q, rank, c, s in got:
            if q in (0, 40) and c != 20:
                assert s == own[q] @ own[c]
        best = sorted(((-(own[40] @ of(e)), i) for i, e, _ in rows if i != 40))[:4]
        assert [(round(-s, 9), c) for q, _, c, s in got if q == 40] == [(round(s, 9), c) for s, c in best]
