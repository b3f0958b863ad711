import random

import pytest
from helpers import components as plain

from lodestar.llm.common import components


@pytest.mark.parametrize("kind", ["path", "random", "star", "empty"])
def test_components(spark, kind):
    rng = random.Random(2)
    ids = list(range(0, 400, 3))
    rng.shuffle(ids)
    pairs = {
        "path": list(zip(ids, ids[1:])),
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)],
        "star": [(7, i) for i in ids if i != 7],
        "empty": [],
    }[kind]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    want = {x: r for x, r in plain((a, b) for a, b in pairs if a != b).items()}
    rows = components(edges).collect()
    assert len(rows) == len(want) and {r["node"]: r["root"] for r in rows} == want
