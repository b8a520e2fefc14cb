from __future__ import annotations

import random

import pytest

from trackloom.llm.graph import components


def smallest(links):
    label = {x: x for pair in links for x in pair}
    while True:
        was = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == was:
            return label


def clique(nodes):
    return [(a, b) for a in nodes for b in nodes if a < b]


def shuffled_path(n, rng):
    at = list(range(n))
    rng.shuffle(at)
    return list(zip(at, at[1:]))


RNG = random.Random(2)
GRAPHS = {
    "path": [(i, i + 1) for i in range(60)],
    "shuffled path": shuffled_path(60, RNG),
    "zigzag": [(i, 100 - i) for i in range(50)] + [(i + 1, 100 - i) for i in range(49)],
    "hub": [(70, i) for i in range(70)] + [(-5, -4)],
    "random": [(RNG.randrange(200), RNG.randrange(200)) for _ in range(130)],
    "repeated": [(3, 2), (2, 3), (3, 2), (9, 9), (5, 6)],
    "none": [(4, 4)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_are_the_smallest_nodes(spark, name):
    links = [(a, b) for a, b in GRAPHS[name] if a != b]
    rows = [*GRAPHS[name], (None, 1), (1, None)]
    got = [tuple(r) for r in components(spark.createDataFrame(rows, "a long, b long")).select("node", "component").collect()]
    assert dict(got) == smallest(links) and len(got) == len(dict(got))


def made_by_joins(spark, work):
    """Rows that all joins of the queries of ``work`` made."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    work()
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    total = 0
    for k in range(before, store.executionsCount()):
        one = store.executionsList().apply(k).executionId()
        values = store.executionMetrics(one)
        nodes = store.planGraph(one).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for metric in (node.metrics().apply(i) for i in range(node.metrics().size())) if "Join" in node.name() else ():
                if metric.name() == "number of output rows":
                    total += int(values.get(metric.accumulatorId()).get().replace(",", "")) if values.contains(metric.accumulatorId()) else 0
    return total


def test_links_of_a_large_group_are_joined_once(spark):
    links = clique(range(120)) + [(1000 + i, 1001 + i) for i in range(20)]
    frame = spark.createDataFrame(links, "a long, b long")
    assert made_by_joins(spark, lambda: components(frame).collect()) < 3 * len(links)
