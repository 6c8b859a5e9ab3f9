"""Exact percentiles without a whole group in one task: against numpy, with ties, nulls and empty inputs."""

import numpy as np
import pytest

from siftspark.operators import measures


def test_percentiles_read_few_ranges(spark):
    r = np.random.default_rng(5)
    rows = [(str(g) if g else None, float(v)) for g, n in enumerate((1, 2, 701, 3000)) for v in r.normal(0, 100, n)]
    rows += [("tied", 7.0)] * 900 + [("tied", 8.0)] * 100 + [("none", None)] * 3
    x = spark.createDataFrame(rows, "g string, v double")
    got = {z.g: z for z in measures.distribution(x, ["g"], "v").collect()}
    for g in {a for a, _ in rows} - {"none"}:
        v = np.array([b for a, b in rows if a == g])
        assert (got[g]["count"], got[g].max) == (len(v), round(v.max(), 3))
        assert [got[g].p50, got[g].p95] == pytest.approx(np.percentile(v, [50, 95]), abs=6e-4)
    assert tuple(got["none"])[1:] == (0, None, None, None, None)
    whole = measures.distribution(x, [], "v")
    v = np.array([b for _, b in rows if b is not None])
    assert [whole.first().p50, whole.first().p95] == pytest.approx(np.percentile(v, [50, 95]), abs=6e-4)
    assert "percentile(" not in whole._jdf.queryExecution().toString()


def test_distribution_of_nothing(spark):
    x = spark.createDataFrame([], "g string, v double")
    assert [tuple(r) for r in measures.distribution(x, [], "v").collect()] == [(0, None, None, None, None)]
    assert measures.distribution(x, ["g"], "v").count() == 0
