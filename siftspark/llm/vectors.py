"""Search over vectors: exact top-k by no-random-access aggregation, approximate top-k by projected kd-trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates, and of a block of queries, that meet in one task; queries looked at together inside it.
CANDIDATES, QUERIES, TOGETHER = 8192, 8192, 512
#: What a search has done, for tests and figures: (queries x candidates) there were, and of them the entries read of each list, the candidates whose projected distance was computed, and those verified or resolved.
WORK = {"all": 0, "read": 0, "projected": 0, "resolved": 0}


def usable(vector: Column, zero: bool = True) -> Column:
    """Whether a vector takes part: not null, no null, NaN or infinite component, and, if zero is false, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    ok = vector.isNotNull() & finite
    return F.coalesce(ok if zero else ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def _in_blocks(vectors: DataFrame, queries: Column, search: Callable, k: int, score: str, kept: Column) -> DataFrame:
    """Every block of queries against every block of candidates, then the best k of each query.

    Blocks are made by hashed ids, so that equal vectors don't share one. A task holds one block of
    each, of bounded size; vectors of another dimension than the query's score nothing.
    """
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), queries.alias("q")).where(kept & F.col("vec_id").isNotNull())
    n, m = v.agg(F.count("*"), F.count_if("q")).first()
    nc, nq = max(1, ceil(n / CANDIDATES)), max(1, ceil(m / QUERIES))
    h = F.xxhash64("vec_id")
    each = lambda x, count, name: x.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    c = each(v.withColumn("cb", F.pmod(h, F.lit(nc)).cast("int")), nq, "qb").select("qb", "cb", "vec_id", "v")
    q = each(v.where("q").withColumn("qb", F.pmod(h, F.lit(nq)).cast("int")), nc, "cb").select("qb", "cb", "vec_id", "v")
    run = partial(_search_block, search, k, score)
    found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(run, f"query_id long, vec_id long, score {score}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _matrices(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows) by dimension, in order of id."""
    ids = t.column("vec_id").to_numpy()
    v = t.column("v").combine_chunks()
    size = np.diff(v.offsets.to_numpy())
    flat, at = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()[:-1]
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        yield ids[rows], flat[at[rows][:, None] + np.arange(d)]


def _search_block(search: Callable, k: int, score: str, q: pa.Table, c: pa.Table) -> pa.Table:
    kind = pa.int64() if score == "long" else pa.float64()
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", kind)])
    out = []
    if q.num_rows and c.num_rows:
        mine = {x.shape[1]: (ids, x) for ids, x in _matrices(q)}
        for ids, x in _matrices(c):
            if x.shape[1] in mine:
                qids, qs = mine[x.shape[1]]
                r, i, s = search(qids, qs, ids, x, k)
                out.append(pa.table([pa.array(qids[r]), pa.array(ids[i]), pa.array(s, kind)], schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def _top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of each row's best k, ties to the lower column; -inf is no score."""
    n, m = scores.shape
    if m > k:
        least = np.partition(scores, m - k, axis=1)[:, m - k]
        r, i = np.nonzero(scores >= least[:, None])
    else:
        r, i = np.nonzero(np.ones((n, m), bool))
    s = scores[r, i]
    r, i, s = (x[s > -np.inf] for x in (r, i, s))
    order = np.lexsort((i, -s, r))
    r, i, s = r[order], i[order], s[order]
    place = np.arange(len(r)) - np.searchsorted(r, r, side="left")
    return r[place < k], i[place < k], s[place < k]


def nra(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact top-k inner products of floor(64 v) by no-random-access aggregation over a block.

    Each component has a sorted list of the candidates; a query reads it from the top where its own
    component is positive, from the bottom where it is negative. All lists are read on together, a
    sixteenth of them at a time. What a candidate's entries have shown gives its partial sum; the
    upper bound adds the lists' frontiers for what has not been read, the lower bound takes off the
    most that the rest can, by the norms of the query's and the candidate's unread parts (squared norms
    are kept beside the lists). Nothing else of a candidate is looked at. A query stops when few
    candidates' upper bounds reach the k-th best lower bound: no outsider can qualify. The final
    scores of these few are then resolved. The bounds of a sample of candidates tell when it pays to bound all.
    """
    most = np.finfo(float).max  # where 64 times a component is beyond a double
    with np.errstate(over="ignore"):
        q, x = (np.clip(np.floor(v * 64), -most, most) for v in (q, x))
    largest = float(max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)))
    top = largest * largest * q.shape[1]
    if top >= 2.0**53:
        return _exact_large(qids, q, ids, x, k)
    kind = np.float32 if top < 2**24 else np.float64  # sums of whole numbers below these are exact
    return _nra(qids, q.astype(kind), ids, x.astype(kind), k)


def _scores(q: np.ndarray, x: np.ndarray, r: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (r, i), r rising: a product of a query with its own rows at a time."""
    out = np.empty(len(r), q.dtype)
    at = np.searchsorted(r, np.arange(len(q) + 1))
    for n in np.unique(r):
        out[at[n] : at[n + 1]] = x[i[at[n] : at[n + 1]]] @ q[n]
    return out


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th best; -inf where there are fewer."""
    m = scores.shape[1]
    return np.partition(scores, m - k, axis=1)[:, m - k] if m >= k else np.full(len(scores), -np.inf)


class _Lists:
    """Sorted lists of a block's components, and what has been read of them: from the top in the first half of the columns, from the bottom in the second."""

    def __init__(self, x: np.ndarray):
        self.order = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, self.order, axis=0)
        self.squares = (x * x).sum(1)
        self.n, self.d, self.depth = *x.shape, 0
        self.seen, self.read = np.zeros((self.n, 2 * self.d), x.dtype), np.zeros((self.n, 2 * self.d), bool)

    def read_to(self, depth: int) -> None:
        cols = np.arange(self.d)
        for part, at in ((slice(self.n - depth, self.n - self.depth), cols), (slice(self.depth, depth), cols + self.d)):
            self.seen[self.order[part], at] = self.values[part]
            self.read[self.order[part], at] = True
        self.depth, self.edge = depth, np.concatenate([self.values[self.n - depth], self.values[depth - 1]])

    def upper(self, both: np.ndarray, rows=slice(None)) -> np.ndarray:
        """Upper bounds of rows for each query: what has been read, and the frontier for the rest."""
        return both @ np.where(self.read[rows], self.seen[rows], self.edge).T

    def lower(self, both: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Lower bounds, (query, row): rows are the same for all queries, or each query's own. Rounding is on the safe side."""
        seen, read = self.seen[rows], self.read[rows]
        per = (lambda a, b: a @ b.T) if rows.ndim == 1 else (lambda a, b: np.matmul(b, a[:, :, None])[:, :, 0])
        known = per(both, seen).astype(float)
        mine = (both * both).sum(1)[:, None] - per(both * both, read.astype(both.dtype))
        theirs = self.squares[rows] - per((both != 0).astype(both.dtype), seen * seen)
        # a query's zero components are read by neither side: they weigh nothing, and theirs stays an upper bound
        return known - np.sqrt(np.maximum(mine, 0).astype(float) * np.maximum(theirs, 0)) * (1 + 1e-6)


def _nra(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, lists, out, active = len(x), _Lists(x), [], np.arange(len(q))
    both = np.hstack([np.maximum(q, 0), np.minimum(q, 0)])
    sample = np.random.default_rng(5).permutation(n)[: max(4 * k, n // 64)]
    likely_rank = max(1, k * len(sample) // n)
    step = max(k + 1, n // 16)
    WORK["all"] += len(q) * n

    def stopped(who: np.ndarray, last: bool) -> np.ndarray:
        """The queries that are done at this depth; their results go to out."""
        if not last:
            reach = _kth(lists.lower(both[who], sample), likely_rank)[:, None]
            who = who[(lists.upper(both[who], sample) >= reach).mean(axis=1) <= 0.125]
            if not len(who):
                return who
        bound = lists.upper(both[who])
        bound[qids[who][:, None] == ids[None, :]] = -np.inf
        lead = np.argpartition(bound, n - 4 * k, axis=1)[:, n - 4 * k :] if n > 4 * k else np.tile(np.arange(n), (len(who), 1))
        least = lists.lower(both[who], lead)
        least[qids[who][:, None] == ids[lead]] = -np.inf
        can = bound >= _kth(least, k)[:, None]
        few = last | (can.sum(axis=1) <= max(4 * k, n // 8))
        who, can = who[few], can[few]
        r, i = np.nonzero(can & (qids[who][:, None] != ids[None, :]))
        WORK["read"] += len(who) * lists.depth
        WORK["resolved"] += len(r)
        s = np.full(can.shape, -np.inf, q.dtype)
        s[r, i] = _scores(q[who], x, r, i)
        found = _top(s, k)
        out.append((who[found[0]], *found[1:]))
        return who

    while len(active):
        depth = min(n, lists.depth + step)
        lists.read_to(depth)
        done = [stopped(active[a : a + TOGETHER], depth == n) for a in range(0, len(active), TOGETHER)]
        active = np.setdiff1d(active, np.concatenate(done))
    r, i, s = (np.concatenate([p[j] for p in out]) if out else np.empty(0, int) for j in range(3))
    return r, i, s.astype(np.int64)


def _exact_large(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with whole numbers of any size, for components that doubles can't sum exactly; scores beyond a long are set to its ends.

    Scores in doubles, with the most that their rounding can be off, tell which candidates can be among the best; these are scored in whole numbers.
    """
    r, i, s = [], [], []
    for a, row in enumerate(q):
        with np.errstate(over="ignore", invalid="ignore"):
            about, off = x @ row, np.abs(x) @ np.abs(row) * (len(row) + 2) * 2.0**-52
            high, low = about + off, about - off
        sure = np.isfinite(high) & np.isfinite(low)
        other = ids != qids[a]
        least = _kth(low[sure & other][None, :], k)[0]
        mine = [int(c) for c in row.tolist()]
        can = np.flatnonzero(other & (~sure | (high >= least)))
        scores = [(-sum(map(int.__mul__, mine, map(int, x[j].tolist()))), j) for j in can]
        for neg, j in sorted(scores)[:k]:
            r.append(a), i.append(j), s.append(max(-(2**63), min(2**63 - 1, -neg)))
    return np.array(r, int), np.array(i, int), np.array(s, np.int64)


def exact_top_k(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """The k best candidates of each query by the inner product of floor(64 v): query_id, rank, vec_id, score.

    Candidates are all rows but those with the query's vec_id. Ties go to the smaller vec_id.
    Null vectors, such with null or non-finite components and rows with a null vec_id take no part;
    a vector only meets those of its dimension; repeated rows count each time, as queries and as
    candidates; other columns are ignored. Components that 64 times are beyond a double count as the largest double.
    """
    return _in_blocks(vectors, queries, nra, k, "long", usable(F.col("embedding")))


def chi_square(p: float, m: int) -> float:
    """The p-quantile of chi-square with an even number m of degrees, by bisection of its closed form."""
    low, high = 0.0, 1e4
    for _ in range(100):
        x = (low + high) / 2
        term, tail = np.exp(-x / 2), 0.0
        for j in range(m // 2):
            tail += term
            term *= x / 2 / (j + 1)
        low, high = (x, high) if 1 - tail < p else (low, x)
    return high


def kd_leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree: median cuts of the widest axis until size rows are left."""
    stack, leaves = [np.arange(len(points))], []
    while stack:
        rows = stack.pop()
        if len(rows) <= size:
            leaves.append(rows)
            continue
        p = points[rows]
        order = np.argpartition(p[:, np.argmax(p.max(0) - p.min(0))], len(rows) // 2)
        stack += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return leaves


class _Band:
    """Candidates of about one norm: their projections in a kd-tree. rows: where they stand in the block. Single precision: it decides what is looked at, scores are doubles."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, lengths: np.ndarray, directions: np.ndarray, leaf: int):
        self.long = float(lengths[rows].max())
        extra = np.sqrt(np.maximum(self.long**2 - lengths[rows] ** 2, 0))
        p = (np.hstack([x[rows], extra[:, None]]) @ directions).astype(np.float32)
        leaves = kd_leaves(p, leaf)
        order = np.concatenate(leaves)
        self.rows, self.p, self.x = rows[order], p[order], x[rows[order]].astype(np.float32)  # leaf by leaf
        self.ids, self.squares = ids[self.rows], (self.p * self.p).sum(1)
        self.size = np.array([len(r) for r in leaves])
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.low, self.high = (f.reduceat(self.p, self.start[:-1], axis=0) for f in (np.minimum, np.maximum))

    def of_leaves(self, some: np.ndarray) -> np.ndarray:
        size = self.size[some]
        return np.repeat(self.start[some] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def bands(lengths: np.ndarray, ratio: float = 1.05, least: int = 256) -> list[np.ndarray]:
    """Rows by falling length, cut where a length is less than the band's longest by ratio; of least rows each, the last may have fewer."""
    order, out, a = np.argsort(-lengths, kind="stable"), [], 0
    falling = -lengths[order]
    while a < len(order):
        b = min(len(order), max(a + least, int(np.searchsorted(falling, falling[a] / ratio, side="right"))))
        out.append(order[a:b])
        a = b
    return out


class _Best:
    """The best of the candidates that a query has verified, with all that are within rounding of the k-th."""

    def __init__(self, k: int):
        self.k, self.rows, self.scores, self.kth = k, np.empty(0, int), np.empty(0, np.float32), -np.inf

    def add(self, rows: np.ndarray, scores: np.ndarray, rounding: float) -> None:
        if self.kth > -np.inf:
            some = scores >= self.kth - rounding
            rows, scores = rows[some], scores[some]
        scores, rows = np.append(self.scores, scores), np.append(self.rows, rows)
        if len(scores) >= self.k:
            self.kth = float(np.partition(scores, len(scores) - self.k)[len(scores) - self.k])
            keep = scores >= self.kth - rounding
            rows, scores = rows[keep], scores[keep]
        self.rows, self.scores = rows, scores


#: Candidates verified before the stopping test is made again grow up to this.
TURN = 1024


def _search_band(band: _Band, qid: int, q: np.ndarray, pq: np.ndarray, square: float, best: _Best, quantile: float, leaf: int) -> None:
    """Verifies a band's candidates in order of their projected distance until the stopping test holds; distances are computed for the leaves opened only."""
    gap = ((np.maximum(band.low - pq, 0) + np.maximum(pq - band.high, 0)) ** 2).sum(1)
    near = np.argsort(gap)
    gap, rounding, away = gap[near], 1e-5 * np.sqrt(square) * band.long, float(pq @ pq)
    limit = lambda: quantile * max(square + band.long**2 - 2 * best.kth, 0) if best.kth > -np.inf else np.inf
    reach, opened, batch, turn = limit(), 0, max(2, ceil(2 * best.k / leaf)), 4 * best.k
    own = bool((band.ids == qid).any())
    rows, apart = np.empty(0, int), np.empty(0, np.float32)  # of leaves opened, not verified
    while True:
        end = min(opened + batch, int(np.searchsorted(gap, reach, side="right")))
        if end > opened:
            more = band.of_leaves(near[opened:end])
            WORK["projected"] += len(more)
            rows, apart = np.append(rows, more), np.append(apart, band.squares.take(more) - 2 * (band.p.take(more, axis=0) @ pq) + away)
            opened, batch = end, 3 * batch
        beyond = gap[opened] if opened < len(gap) else np.inf  # no leaf left holds any that are nearer
        order = np.argsort(apart)
        rows, apart, a = rows.take(order), apart.take(order), 0
        while (b := min(a + turn, int(np.searchsorted(apart, min(reach, beyond), side="right")))) > a:
            now = rows[a:b]
            if own:
                now = now[band.ids.take(now) != qid]
            WORK["resolved"] += len(now)
            best.add(band.rows.take(now), band.x.take(now, axis=0) @ q, rounding)
            reach, turn, a = limit(), min(2 * turn, max(TURN, 4 * best.k)), b
        rows, apart = rows[a:], apart[a:]
        if beyond > reach or opened == len(gap):
            return


def _scaled(v: np.ndarray) -> np.ndarray:
    """All components by the same power of two, so that no square is beyond a double and equal ones stay equal."""
    return np.ldexp(v, -int(np.frexp(np.abs(v).max())[1]))


def projected(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, m: int = 16, p: float = 0.87, leaf: int = 64, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest inner products by incremental neighbours in projected kd-trees, with a chi-square stop.

    Candidates lie in bands of about one norm, the longest first. A component sqrt(M^2 - |x|^2) makes
    all of a band as long as its longest, M, so the largest inner product is the smallest distance.
    They are projected by m Gaussian (2-stable) directions and indexed in a kd-tree. A query opens
    the tree's leaves from the nearest on and verifies the candidates of those it has opened in order
    of their distance D to its projection. For a vector at distance d the squared projected distance
    over d^2 follows chi-square with m degrees, so once D^2 exceeds the p-quantile times the squared
    distance of the k-th best so far, each better vector left would have been met with probability
    p at least: it stops. Bands that can't reach the k-th best by their norm are not searched.
    """
    whole, q, x = (q, x), _scaled(q), _scaled(x)
    lengths = np.sqrt((x * x).sum(1))
    directions = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, m))
    index = [_Band(x, ids, rows, lengths, directions, leaf) for rows in bands(lengths)]
    pq, square, quantile, single = (q @ directions[:-1]).astype(np.float32), (q * q).sum(1), chi_square(p, m), q.astype(np.float32)
    rows, columns = [], []
    for n in range(len(q)):
        best = _Best(k)
        for band in index:
            if np.sqrt(square[n]) * band.long * (1 + 1e-5) < best.kth:
                break
            _search_band(band, qids[n], single[n], pq[n], square[n], best, quantile, leaf)
        WORK["all"] += len(x)
        rows.append(np.full(len(best.rows), n))
        columns.append(best.rows)
    r, i = (np.concatenate(v) if v else np.empty(0, int) for v in (rows, columns))
    with np.errstate(over="ignore", invalid="ignore"):
        s = np.einsum("ij,ij->i", whole[0][r], whole[1][i])
    by = np.lexsort((i, -s, r))
    r, i, s = r[by], i[by], s[by]
    place = np.arange(len(r)) - np.searchsorted(r, r, side="left")
    return r[place < k], i[place < k], s[place < k]


def near_top_k(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """About the k largest inner products of each query: query_id, rank, vec_id, score (exact for the pair).

    All rows are indexed: each block of candidates has a kd-tree of its own, which every query
    searches, so a query misses a neighbour only where the stopping test of that block fails.
    Zero vectors, null ones, such with null or non-finite components and rows with a null vec_id
    take no part; otherwise as exact_top_k().
    """
    return _in_blocks(vectors, queries, projected, k, "double", usable(F.col("embedding"), zero=False))
