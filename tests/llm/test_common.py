"""Connected components, and the shared folder."""

import pytest

from siftspark.llm.common import Scratch, components


def found(spark, edges):
    return {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}


def test_chains_hubs_loops_and_nulls(spark):
    assert found(spark, []) == {} and found(spark, [(1, 1), (None, 2), (3, None)]) == {}
    assert found(spark, [(i, i + 1) for i in range(10, 40)]) == dict.fromkeys(range(10, 41), 10)
    hub = [(500, i) for i in range(300)] + [(500, i) for i in range(300)] + [(1000, 1001), (1001, 1000), (1000, 1000)]
    assert found(spark, hub) == {**dict.fromkeys([*range(300), 500], 0), 1000: 1000, 1001: 1000}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="checkpoint"):
        Scratch(Session())
