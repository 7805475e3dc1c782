import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import graph as G

NODE, EDGE = "id string, sort_key string", "id string, sort_key string, role string, src string, dst string, weight double"


def build(spark, nodes, edges):
    n = spark.createDataFrame([(x, f"k-{x}") for x in nodes], NODE)
    rows = [(e[0], e[0] if len(e) < 5 else e[4], "r", e[1], e[2], float(e[3]) if len(e) > 3 and e[3] is not None else None) for e in edges]
    return n, spark.createDataFrame(rows, EDGE)


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


F1 = [("e1", "A", "C", 3), ("e2", "B", "C", 1), ("e3", "C", "D", 2)]


def test_waves_whatever_the_order(spark):
    for seed in range(2):
        edges = random.Random(seed).sample(F1, 3)
        assert as_dict(G.waves(*build(spark, "DBCA", edges))) == {"A": 0, "B": 0, "C": 1, "D": 2}


def test_waves_without_edges_and_without_nodes(spark):
    assert set(as_dict(G.waves(*build(spark, "ABCD", []))).values()) == {0}
    assert as_dict(G.waves(*build(spark, "", []))) == {}


def test_longest_paths(spark):
    nodes, edges = build(spark, "ABCD", F1)
    paths = G.longest_paths(nodes, edges)
    assert {r.id: (r.value, r.via_edge) for r in paths.collect()} == {"A": (0, None), "B": (0, None), "C": (3, "e1"), "D": (5, "e3")}
    assert G.critical_path(nodes, edges, paths) == ["A", "C", "D"]


@pytest.mark.parametrize("edges, values, bad", [
    ([("p2", "A", "C", 5, "s"), ("p1", "A", "C", 5, "s")], {"A": 0, "C": 5}, set()),
    ([("e", "A", "B", -5), ("f", "A", "C", -1)], {"A": 0, "B": -5, "C": -1}, set()),
    ([("a", "A", "B", 1e308), ("b", "B", "C", 1e308), ("c", "C", "D", 0), ("d", "A", "D", 0)], None, {"C", "D"}),
    ([("a", "S", "N", -1e308), ("b", "N", "T", -1e308), ("c", "S", "T", 0)], None, {"T"}),
])
def test_longest_path_cases(spark, edges, values, bad):
    rows = G.longest_paths(*build(spark, sorted({x for e in edges for x in e[1:3]}), edges)).collect()
    assert {r.id for r in rows if r.overflow} == bad
    if values:
        assert {r.id: r.value for r in rows} == values
    assert all(r.via_edge in (None, "p1") for r in rows if r.id == "C" and edges[0][0] == "p2")


def test_components_condensation_and_witness(spark):
    nodes, edges = build(spark, "ABCD", [("x", "A", "B"), ("y", "B", "A"), ("c1", "C", "A")])
    assert as_dict(G.strong_components(nodes, edges)) == {"A": "A", "B": "A", "C": "C", "D": "D"}
    assert [r.id for r in G.condensed(nodes, edges)[1].collect()] == ["c1"]
    assert G.cycle_witness(nodes, edges) == ["A", "B"]
    with pytest.raises(G.NotADag) as e:
        G.waves(*build(spark, "A", [("z", "A", "A")]))
    assert e.value.args[0] == ["A"]


def test_findings_and_reachability(spark):
    nodes, edges = build(spark, "ABC", [("e", "A", "B"), ("f", "B", "Z")])
    assert [(r.code, r.subject) for r in G.graph_findings(nodes, edges).collect()] == [("unresolved-endpoint", "f.to")]
    twice = nodes.unionAll(nodes.where("id = 'A'"))
    assert [(r.code, r.subject) for r in G.graph_findings(twice, edges).collect()] == [("duplicate-node-id", "A")]
    nodes, edges = build(spark, "ABC", [("e", "A", "B"), ("g", "C", "A")])
    got = G.reachable(nodes, edges, spark.createDataFrame([("A",)], "id string"))
    assert sorted(r.id for r in got.collect()) == ["A", "B"]
    with pytest.raises(ValueError, match="unknown-start-node"):
        G.reachable(nodes, edges, spark.createDataFrame([("Q",)], "id string"))


@pytest.mark.parametrize("rounds", [True, False])
def test_rounds_and_whole_components_agree(spark, monkeypatch, rounds):
    """Random graphs: the distributed forms against plain Python."""
    rng = random.Random(5)
    names = [f"n{i:02d}" for i in range(14)]
    dag = [(f"e{i}", *sorted(rng.sample(names, 2)), rng.randint(1, 9)) for i in range(22)]
    loops = dag + [(f"b{i}", *sorted(rng.sample(names, 2), reverse=True), 1) for i in range(4)]
    if rounds:
        monkeypatch.setattr(G, "COMPONENT_ROWS", 0)
    nodes, edges = build(spark, names, dag)
    level, value = {n: 0 for n in names}, {n: None for n in names}
    for n in names:
        into = [e for e in dag if e[2] == n]
        level[n] = max((level[e[1]] + 1 for e in into), default=0)
        value[n] = max((value[e[1]] + e[3] for e in into), default=0)
    assert as_dict(G.waves(nodes, edges)) == level
    assert as_dict(G.longest_paths(nodes, edges).select("id", "value")) == value
    reach = {n: {n} for n in names}
    for _ in names:
        for e in loops:
            for n in names:
                if e[1] in reach[n]:
                    reach[n] |= {e[2]}
    want = {n: min(m for m in names if m in reach[n] and n in reach[m]) for n in names}
    nodes, edges = build(spark, names, loops)
    assert as_dict(G.strong_components(nodes, edges)) == want
    got = G.reachable(nodes, edges, spark.createDataFrame([("n05",)], "id string"))
    assert {r.id for r in got.collect()} == reach["n05"]


def test_a_chain_of_100000(spark):
    n = 100_000
    nodes = spark.range(n).select(F.format_string("n%06d", "id").alias("id"), F.format_string("n%06d", "id").alias("sort_key"))
    edges = spark.range(n - 1).select(F.format_string("e%06d", "id").alias("id"), F.format_string("e%06d", "id").alias("sort_key"), F.lit("r").alias("role"), F.format_string("n%06d", "id").alias("src"), F.format_string("n%06d", F.col("id") + 1).alias("dst"), F.lit(None).cast("double").alias("weight"))
    assert G.waves(nodes, edges).agg(F.max("wave"), F.count("*")).first()[:] == (n - 1, n)
