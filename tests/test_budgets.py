"""The budget of contexts and batches of reviews, against plain loops."""

import random
import time
from collections import defaultdict

import pytest

from siftspark.operators import batches, budget, manifests
from siftspark.operators.planning import CATEGORIES

CHUNKS = "pair_id int, category string, place int, document_id int, chunk_id string, text string"


def evicted(rows, limit):
    """Chunks (category, place, document, chunk, text) of one pair: what goes, in order, and the characters that stay."""
    queues = {c: [r for r in sorted(rows, key=lambda r: r[1]) if r[0] == c] for c in CATEGORIES}
    used = lambda: sum(len(t) for _, _, t in {(d, k or "", t or "") for q in queues.values() for _, _, d, k, t in q})
    gone = []
    while used() > limit:
        worst = max(CATEGORIES, key=lambda c: sum(len(r[4] or "") for r in queues[c]))
        gone.append(queues[worst].pop())
    return gone, used()


@pytest.mark.parametrize("limit", [0, 40, 10_000])
def test_largest_category_gives_way(spark, limit):
    r, rows = random.Random(limit), []
    for pair in range(25):
        shared = ["x" * r.randrange(1, 30) for _ in range(4)] + [None, "", "same"]
        for c in CATEGORIES:
            rows += [(pair, c, k, r.randrange(2), r.choice(["a", "b", None]), r.choice(shared)) for k in range(r.randrange(7))]
    got, want = defaultdict(dict), defaultdict(dict)
    for x in budget.within_budget(spark.createDataFrame(rows, CHUNKS), limit).collect():
        got[x.pair_id][x.category, x.place] = (x.omitted, x.evidence_chars)
    for pair in {x[0] for x in rows}:
        mine = [x[1:] for x in rows if x[0] == pair]
        gone, used = evicted(mine, limit)
        numbers = {(g[0], g[1]): n + 1 for n, g in enumerate(gone)}
        want[pair] = {(c, k): (numbers.get((c, k)), used) for c, k, *_ in mine}
    assert got == want
    assert budget.within_budget(spark.createDataFrame([], CHUNKS), limit).count() == 0


def test_what_is_left_is_filled(spark):
    chunks = spark.createDataFrame([(1, "SKILLS", 1, 1, "2", "s" * 30), (1, "SKILLS", 2, 1, "0", "t" * 30)], CHUNKS)
    kept = budget.within_budget(chunks, 50)
    assert {(x.place, x.omitted) for x in kept.collect()} == {(1, None), (2, 1)}
    passages = spark.createDataFrame([(1, i, 0, "CONTEXT", t) for i, t in enumerate(["a" * 9, "b" * 9, "c" * 30, "d" * 9, "must e"])], "pair_id int, idx int, section int, category string, text string")
    got = [(x.idx, x.included) for x in budget.filled(kept.withColumn("chunk_id", kept.chunk_id.cast("int")), passages, 50, ("must",)).orderBy("place").collect()]
    assert got == [(4, True), (1, True), (2, False), (3, False), (0, False)]  # 30 + 6 + 9, then 30, 9 and 9 don't fit


def folded(rows, pairs):
    """Batches in order, one by one."""
    version, out = defaultdict(int), {}
    for b, decision, reason in sorted(rows, key=lambda x: x[0]):
        want = {(p, v) for q, p, v in pairs if q == b}
        if decision == batches.NEEDS_REASON and not (reason or "").strip():
            out[b] = (False, batches.NO_REASON)
        elif any(version[p] != v for p, v in want):
            out[b] = (False, batches.CONFLICT)
        else:
            out[b] = (True, None)
            for p in {p for p, _ in want}:
                version[p] += 1
    return out, dict(version)


def frames(spark, rows, pairs):
    return spark.createDataFrame(rows, "batch int, decision string, reason string"), spark.createDataFrame(pairs, "batch int, pair_id int, version int")


@pytest.mark.parametrize("seed", [1, 2])
def test_overlapping_batches_equal_a_plain_loop(spark, seed):
    r = random.Random(seed)
    rows = [(b, r.choice(["HOLD", "HOLD", "NOT_PROCEEDING", None]), r.choice([None, " ", "late", "late"])) for b in r.sample(range(500), 90)]
    pairs = []
    now = defaultdict(int)
    for b, *_ in sorted(rows):
        for p in r.sample(range(12), r.randrange(0, 4)):
            pairs.append((b, p, max(0, now[p] + r.choice([0, 0, 0, 0, -1, 1, 2]))))
            now[p] += r.random() < 0.5
    pairs += pairs[:5] + [(rows[0][0], 3, 0), (rows[0][0], 3, 1), (10_000, 1, 0)]  # the last is no batch
    want, versions = folded(rows, [x for x in pairs if x[0] != 10_000])
    b, e = frames(spark, rows, pairs)
    got = batches.decided_batches(b, e)
    assert {x.batch: (x.accepted, x.code) for x in got.collect()} == want and sum(a for a, _ in want.values()) > 10
    state = batches.review_state(b.selectExpr("*", "cast(null as string) as notes", "cast(null as string) as tags", "'x' as assignee"), e, got)
    assert {x.pair_id: x.version for x in state.collect()} == {p: v for p, v in versions.items() if v}


def test_one_stale_version_changes_nothing(spark):
    b, e = frames(spark, [(1, "HOLD", None), (2, "HOLD", None), (3, "HOLD", None), (4, "NOT_PROCEEDING", " ")], [(1, 7, 0), (2, 7, 0), (2, 8, 0), (3, 8, 0), (4, 9, 0)])
    assert {x.batch: x.code for x in batches.decided_batches(b, e).collect()} == {1: None, 2: "VERSION_CONFLICT", 3: None, 4: "REASON_REQUIRED"}
    none = batches.decided_batches(*frames(spark, [], []))
    assert none.count() == 0


def test_notes_stay_where_a_batch_has_none(spark):
    rows = [(1, "HOLD", None, "first", "a", "ann"), (2, "HOLD", " because ", None, None, None), (3, "HOLD", None, "third", None, "")]
    b = spark.createDataFrame(rows, "batch int, decision string, reason string, notes string, tags string, assignee string")
    e = spark.createDataFrame([(k, p, v) for k, p, v in [(1, 1, 0), (2, 1, 1), (1, 2, 0), (3, 2, 1)]], "batch int, pair_id int, version int")
    got = {x.pair_id: (x.version, x.batch, x.reason, x.notes, x.tags, x.assignee) for x in batches.review_state(b, e, batches.decided_batches(b, e)).collect()}
    assert got == {1: (2, 2, "because", "first", "a", "ann"), 2: (2, 3, "", "third", "a", None)}


def test_folds_take_time_in_proportion_to_rows():
    """A pair of 100,000 chunks or passages: a fold whose steps look at all rows again does not end in this time."""
    n, start = 100_000, time.process_time()
    queues = sorted(1 + k % 4 for k in range(n))
    omitted, used = budget.losses(queues, [str(k % 70_000) for k in range(n)], [3] * n, 300)
    assert used <= 300 < used + 4 * 3 and sum(o is None for o in omitted) * 3 >= used and max(o for o in omitted if o) == sum(o is not None for o in omitted)
    assert sum(manifests.taken([5] * n, 0, 4_999)) == 999 and manifests.taken([3, None, 9, 2], 1, 6) == [True, None, False, True]
    assert time.process_time() - start < 10
