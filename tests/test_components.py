import random

import pytest

from kinfold.operators.components import component_ids, components


def plain(edges):
    least = {x: x for e in edges for x in e}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        least[b] = a
    return {x: root(x) for x in least}


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs_chains_and_stars(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    edges += [(1000 + i, 1001 + i) for i in range(150)] + [(5000, 5001 + i) for i in range(100)] + [(7, 7), (-3, -9), (9000, 9000)]
    rng.shuffle(edges)
    found = component_ids(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.component for r in found} == plain(edges)


def test_nulls_and_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    found = component_ids(spark.createDataFrame([(1, None), (None, None), (2, 3), (2, 3)], "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {2: 2, 3: 2}
