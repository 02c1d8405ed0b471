"""Rounds of the component search use as many tasks as their edges need."""

import random

from answerloom.operators import components


def _brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


def _edges():
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    return edges, _brute([e for e in edges if e[0] != e[1]])


def test_few_edges_make_few_files(spark):
    edges, wanted = _edges()
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
        assert found.rdd.getNumPartitions() <= 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["id"]: r["root"] for r in found.collect()} == wanted


def test_many_tasks_find_the_same(spark, monkeypatch):
    edges, wanted = _edges()
    monkeypatch.setattr(components, "EDGES", 20)
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["root"] for r in found.collect()} == wanted
