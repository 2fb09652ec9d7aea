"""Connected components against union-find."""

import random

from riskfold.llm.components import components


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)]                            # a path
    edges += [(500 + rng.randrange(60), 500 + rng.randrange(60)) for _ in range(45)]
    edges += [(900, 900 + i) for i in range(1, 9)]                        # a star
    edges += [(959, 950 + i) for i in range(9)] + [(7, 6), (3, 3)]        # its pivot is the largest; repeats, a loop
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted((x, find(x)) for x in linked)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
