import random

import pytest

from sieveline.llm.components import roots


def brute(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent if find(x) != x}


@pytest.mark.parametrize("local", [0, 10**6])
def test_components(spark, local):
    r = random.Random(3)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(12)] + [(5, 5), (None, 1), (3, None)]
    df = spark.createDataFrame(links, "u long, v long")
    assert {x.u: x.v for x in roots(df, local).collect()} == brute(links)
    assert roots(df.limit(0), local).count() == 0
