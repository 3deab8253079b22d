import itertools
import random

import pytest

from strataform.operators import graph as G
from strataform.operators import steiner as S


def brute(problem):
    """The tree with the least mean weight among all edge sets that are trees over the terminals, with leaves that are terminals."""
    best = None
    edges = sorted(problem.weight)
    for n in range(1, len(edges) + 1):
        for tree in itertools.combinations(edges, n):
            tree = frozenset(tree)
            targets = {t for _, t, _ in tree}
            roots = {s for s, _, _ in tree} - targets
            if len(roots) != 1 or not all(t in targets for t in problem.terminals):
                continue
            leaves = targets - {s for s, _, _ in tree}
            if leaves - set(problem.terminals) or not problem.sound(tree, next(iter(roots))):
                continue
            cost = problem.cost(tree)
            best = min(best or cost, cost)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_steiner_against_brute_force(seed):
    r = random.Random(seed)
    classes, columns = ["A", "B", "C"], ["column:0", "column:1", "column:2"]
    edges = {(a, b, "p"): r.uniform(1, 9) for a in classes for b in classes if a < b and r.random() < 0.8}
    edges |= {(a, c, "q"): r.uniform(1, 9) for a in classes for c in columns if r.random() < 0.6}
    problem = S.Problem(edges, frozenset(), tuple(columns))
    found, want = S.solve(problem), brute(problem)
    if want is None:
        assert not found
    else:
        assert problem.sound(found[0], next(iter({s for s, _, _ in found[0]} - {t for _, t, _ in found[0]})))
        assert problem.cost(found[0])[1] <= want[1] + 1e-9


def test_statement_keeps_its_main_property():
    w = {("A", "s", "p"): 1.0, ("s", "column:0", "p"): 5.0, ("s", "column:1", "q"): 1.0}
    problem = S.Problem(w, frozenset({"s"}), ("column:1",))
    assert S.solve(problem)[0] == frozenset(w)
    with pytest.raises(ValueError, match="main property"):
        S.ensure_statements(frozenset({("A", "s", "p"), ("s", "column:1", "q")}), problem)
    assert S.ensure_statements(frozenset({("A", "s", "p"), ("s", "column:1", "q")}), problem, create=True) == frozenset(w)


def test_nothing_without_terminals_or_roots():
    assert S.solve(S.Problem({("A", "B", "p"): 1.0}, frozenset(), ())) == []
    assert S.solve(S.Problem({("A", "column:0", "p"): 1.0, ("B", "column:1", "p"): 1.0}, frozenset(), ("column:0", "column:1"))) == []


def test_constraints_go_before_weight():
    w = {("A", "s", "p"): 1.0, ("s", "column:0", "p"): 1.0, ("s", "column:1", "p"): 1.0, ("A", "column:1", "r"): 50.0}
    loose, strict = (S.Problem(w, frozenset({"s"}), ("column:0", "column:1"), strict=x) for x in (False, True))
    assert ("s", "column:1", "p") in S.solve(loose)[0] and ("A", "column:1", "r") in S.solve(strict)[0]


def test_context_takes_the_best_path():
    tree = frozenset({("A", "column:0", "p")})
    every = {("A", "m", "x"): 0.5, ("m", "e", "y"): 0.5, ("A", "n", "x"): 0.9, ("n", "e", "y"): 0.4, ("A", "o", "P31"): 1.0, ("o", "e", "P31"): 1.0}
    assert S.add_context(tree, every, ["e"]) == tree | {("A", "n", "x"), ("n", "e", "y")}


def test_trees_and_models_in_spark(spark):
    nodes = spark.createDataFrame([("t", "class:A:0", "class", None, "A"), ("t", "column:0", "column", 0, None), ("t", "column:1", "column", 1, None), ("u", "column:0", "column", 0, None)], "table_id string, node_id string, kind string, col_index int, uri string")
    edges = spark.createDataFrame([("t", "class:A:0", "column:0", "p", 0.5), ("t", "class:A:0", "column:1", "q", 0.9), ("t", "class:A:0", "column:1", "r", 0.8), ("t", "class:A:0", "column:1", "z", 0.0)], "table_id string, src string, dst string, key string, prob double")
    tree = S.steiner_trees(nodes, edges)
    assert {(r.dst, r.key) for r in tree.collect()} == {("column:0", "p"), ("column:1", "q")}
    sm, links = S.tree_to_model(tree, nodes, keep_missing=True)
    assert {(r.table_id, r.kind) for r in sm.collect()} == {("t", "class"), ("t", "data"), ("u", "data")} and links.count() == 2


def test_statement_graph(spark):
    types = spark.createDataFrame([("t", 0, "Site", "label", 0.9), ("t", 1, "Site", "name", 0.8), ("t", 2, "Country", "label", 0.7)], "table_id string, col_index int, class string, prop string, score double")
    data = spark.createDataFrame([("name", "name", "Site", None, 1.0, 1.0, 1.0)], "prop string, qual string, source_type string, target_type string, freq double, inherit_freq double, total_freq double")
    objects = spark.createDataFrame([("in", "in", "Site", "Country", 3.0, 3.0, 4.0)], data.schema)
    entity = spark.createDataFrame([("t", 0), ("t", 2)], "table_id string, col_index int")
    nodes, edges = G.statement_graph(types, data, objects, entity)
    kinds = {r.node_id: r.kind for r in nodes.collect()}
    assert sorted(kinds.values()).count("statement") == 2 and kinds["column:1"] == "column"
    assert {round(r.score, 2) for r in edges.where("key = 'in'").collect()} == {0.75}
