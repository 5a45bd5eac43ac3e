import random

import pytest

from lodestone.llm import components as module
from lodestone.llm.components import components


@pytest.mark.parametrize("few", [0, 30, 200_000])
def test_components(spark, monkeypatch, few):
    """Drawn together round by round, by one task, or by one after the other."""
    monkeypatch.setattr(module, "FEW", few)
    rnd = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100 + rnd.randrange(40), 100 + rnd.randrange(40)) for _ in range(25)] + [(500, k) for k in range(501, 540)] + [(7, 7), (900, 899)]
    root = {v: v for e in edges for v in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.v: r.c for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in root}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
