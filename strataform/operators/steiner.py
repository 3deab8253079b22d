"""Minimum Steiner trees over candidate graphs: one small search per table, in a grouped function.

A solution is a set of edges that forms a directed tree from one root to every terminal (column). States are merged terminal by terminal
and cut to a beam; a table's graph has a few hundred edges, so the search is ordinary Python, while tables are spread over the cluster.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The widths of the beams.
TREES, PATHS = 50, 50
Edge = tuple[str, str, str]  # source, target, key


@dataclass
class Problem:
    """A candidate graph with weights, its statements and terminals."""

    weight: dict[Edge, float]
    statements: frozenset[str]
    terminals: tuple[str, ...]
    #: Hard constraints: no two edges of one key out of a statement, and nothing below the target of a qualifier.
    strict: bool = False
    into: dict[str, list[Edge]] = field(default_factory=lambda: defaultdict(list))
    out: dict[str, list[Edge]] = field(default_factory=lambda: defaultdict(list))

    def __post_init__(self):
        for e in sorted(self.weight):
            self.into[e[1]].append(e)
            self.out[e[0]].append(e)

    def paths_up(self, terminal: str, most: int = PATHS) -> dict[str, list[tuple[Edge, ...]]]:
        """The ``most`` lightest simple paths from each node down to ``terminal``."""
        found: dict[str, list[tuple[Edge, ...]]] = defaultdict(list)
        heap: list[tuple[float, int, str, tuple[Edge, ...]]] = [(0.0, 0, terminal, ())]
        serial = 0
        while heap:
            cost, _, node, path = heappop(heap)
            if len(found[node]) >= most:
                continue
            found[node].append(path)
            seen = {terminal, *(e[0] for e in path)}
            for e in self.into[node]:
                if e[0] not in seen and len(found[e[0]]) < most:
                    serial += 1
                    heappush(heap, (cost + self.weight[e], serial, e[0], (e, *path)))
        return found

    def with_main_property(self, tree: frozenset[Edge]) -> frozenset[Edge]:
        """Give every statement of ``tree`` the edge of its main property: the one with the key of its edge in, the lightest of several."""
        more = set(tree)
        for s in {n for e in tree for n in e[:2]} & self.statements:
            keys = {e[2] for e in self.into[s]}
            if not any(e[0] == s and e[2] in keys for e in tree):
                options = [e for e in self.out[s] if e[2] in keys]
                if options:
                    more.add(min(options, key=lambda e: (self.weight[e], e)))
        return frozenset(more)

    def sound(self, tree: frozenset[Edge], root: str) -> bool:
        """Whether ``tree`` is a directed tree below ``root`` (plus what hangs off statements), without parallel edges."""
        parents: dict[str, str] = {}
        for s, t, _ in tree:
            if t in parents:
                return False
            parents[t] = s
        for node in parents:
            seen = {node}
            while node in parents:
                node = parents[node]
                if node in seen:
                    return False
                seen.add(node)
            if node != root:
                return False
        return True

    def resolve(self, tree: frozenset[Edge]) -> frozenset[Edge]:
        """Of several ways within two edges from one node to another keep the lightest; a direct edge counts twice."""
        edges = set(tree)
        while True:
            into: dict[str, list[Edge]] = defaultdict(list)
            for e in sorted(edges):
                into[e[1]].append(e)
            worse: set[Edge] = set()
            for node in sorted(into):
                if len(into[node]) < 2:
                    continue
                ways: dict[str, list[tuple[float, tuple[Edge, ...]]]] = defaultdict(list)
                for e in into[node]:
                    ways[e[0]].append((2 * self.weight[e], (e,)))
                    for up in into[e[0]]:
                        ways[up[0]].append((self.weight[up] + self.weight[e], (up, e)))
                for options in ways.values():
                    ranked = sorted(options)
                    if len(ranked) > 1:
                        best = set(ranked[0][1])
                        worse |= {e for _, way in ranked[1:] for e in way} - best
                if worse:
                    break
            if not worse:
                return frozenset(edges)
            edges -= worse

    def cost(self, tree: frozenset[Edge]) -> tuple:
        """What solutions are ordered by: constraints broken, mean weight, a statement without source, depth; then the edges."""
        targets = {t for _, t, _ in tree}
        orphans = any(s not in targets for s, _, _ in tree if s in self.statements)
        down: dict[str, list[str]] = defaultdict(list)
        for s, t, _ in tree:
            down[s].append(t)

        def depth(node: str) -> int:
            return 1 + max(map(depth, down[node]), default=0)

        roots = {s for s, _, _ in tree} - targets
        broken = self.strict and not self.meets_constraints(tree)
        return broken, sum(self.weight[e] for e in tree) / max(len(tree), 1), orphans, max(map(depth, roots), default=0), sorted(tree)

    def meets_constraints(self, tree: Iterable[Edge]) -> bool:
        tree = list(tree)
        keys_in = {t: k for _, t, k in tree}
        sources = {s for s, _, _ in tree}
        seen: set[tuple[str, str]] = set()
        for s, t, k in tree:
            if s in self.statements:
                if (s, k) in seen or (k != keys_in.get(s) and t in sources):
                    return False
                seen.add((s, k))
        return True


def solve(problem: Problem, trees: int = TREES, paths: int = PATHS) -> list[frozenset[Edge]]:
    """Solutions, best first; none if no node reaches all terminals."""
    if not problem.terminals:
        return []
    ups = [problem.paths_up(t, paths) for t in sorted(problem.terminals)]
    roots = set.intersection(*(set(u) for u in ups)) - problem.statements
    out: set[frozenset[Edge]] = set()
    for root in sorted(roots):
        states: list[frozenset[Edge]] = [frozenset()]
        for up in ups:
            merged = {problem.resolve(problem.with_main_property(s | frozenset(p))) for s in states for p in up[root]}
            fit = [t for t in merged if not t or problem.sound(t, root)]
            states = sorted(fit, key=problem.cost)[:trees]
        covered = lambda t: all(x == root or any(e[1] == x for e in t) for x in problem.terminals)
        out.update(t for t in states if t and covered(t))
    return sorted(out, key=problem.cost)


def without_dangling(tree: Iterable[Edge], statements: frozenset[str]) -> frozenset[Edge]:
    """Without statements that lack an edge in or out."""
    edges = list(tree)
    sources, targets = {s for s, _, _ in edges}, {t for _, t, _ in edges}
    bad = {n for n in (sources | targets) & statements if n not in sources or n not in targets}
    return frozenset(e for e in edges if not bad & {e[0], e[1]})


def add_context(tree: frozenset[Edge], every: dict[Edge, float], context: Sequence[str], skip: Sequence[str] = ("wdt:P31", "P31")) -> frozenset[Edge]:
    """Hang nodes of the context (entities, literals) on the tree by their most probable path of two edges from one of its nodes."""
    nodes = {n for e in tree for n in e[:2]}
    out = set(tree)
    for node in sorted(context):
        if node in nodes:
            continue
        options = []
        for last in every:
            if last[1] != node or last[2] in skip:
                continue
            for first in every:
                if first[1] == last[0] and first[0] in nodes and first[2] not in skip:
                    options.append((-(every[first] + every[last]), first, last))
        if options:
            _, first, last = min(options)
            out |= {first, last}
    return frozenset(out)


def ensure_statements(tree: frozenset[Edge], problem: Problem, create: bool = False, safe: frozenset[str] | None = None) -> frozenset[Edge]:
    """Every statement has its main property; otherwise an error, or with ``create`` the lightest edge to a target that is added.

    ``safe``: only these nodes (entities and literals) may be added, and only where they aren't in the tree yet.
    """
    out, nodes = set(tree), {n for e in tree for n in e[:2]}
    for s in sorted(nodes & problem.statements):
        keys = {e[2] for e in tree if e[1] == s}
        if any(e[0] == s and e[2] in keys for e in tree):
            continue
        options = [e for e in problem.out[s] if e[2] in keys and (safe is None or (e[1] in safe and e[1] not in nodes))]
        if not create or not options:
            raise ValueError(f"statement {s} lacks its main property")
        best = min(options, key=lambda e: (problem.weight[e], e))
        out.add(best)
        nodes.add(best[1])
    return frozenset(out)


def steiner_trees(nodes: DataFrame, edges: DataFrame, floor: float = 1e-7, strict: bool = False, trees: int = TREES, paths: int = PATHS) -> DataFrame:
    """The best tree of each table: table_id, src, dst, key, prob, weight. Tables without one have no rows.

    ``nodes`` has table_id, node_id, kind, in_context; ``edges`` table_id, src, dst, key, prob. Edges under ``floor`` are dropped first, as
    are dangling statements and nodes on their own. Weights are reciprocal probabilities. One task handles a table's whole graph.
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        statements = frozenset(frame.loc[frame["src_kind"] == "statement", "src"]) | frozenset(frame.loc[frame["dst_kind"] == "statement", "dst"])
        prob: dict[Edge, float] = {}
        for s, t, k, p in zip(frame["src"], frame["dst"], frame["key"], frame["prob"], strict=True):
            prob[s, t, k] = max(p, prob.get((s, t, k), 0.0))
        live = without_dangling(prob, statements)
        columns = sorted({n for n, kind in [*zip(frame["src"], frame["src_kind"]), *zip(frame["dst"], frame["dst_kind"])] if kind == "column"} & {n for e in live for n in e[:2]})
        problem = Problem({e: 1.0 / prob[e] for e in live}, statements, tuple(columns), strict)
        found = solve(problem, trees, paths)
        best = without_dangling(found[0], statements) if found else frozenset()
        if best:
            context = {n for n, c in [*zip(frame["src"], frame["src_context"]), *zip(frame["dst"], frame["dst_context"])] if c}
            best = add_context(best, {e: prob[e] for e in live}, sorted(context))
        rows = [(key[0], *e, prob[e], 1.0 / prob[e]) for e in sorted(best)]
        return pd.DataFrame(rows, columns=["table_id", "src", "dst", "key", "prob", "weight"])

    info = nodes.select("table_id", F.col("node_id").alias("n"), "kind", F.coalesce(F.col("in_context") if "in_context" in nodes.columns else F.lit(False), F.lit(False)).alias("ctx"))
    end = lambda c: info.select("table_id", F.col("n").alias(c), F.col("kind").alias(f"{c}_kind"), F.col("ctx").alias(f"{c}_context"))
    joined = edges.where((F.col("prob") >= floor) & (F.col("prob") > 0)).join(end("src"), ["table_id", "src"]).join(end("dst"), ["table_id", "dst"])
    return joined.groupBy("table_id").applyInPandas(run, "table_id string, src string, dst string, key string, prob double, weight double")


def tree_to_model(tree: DataFrame, nodes: DataFrame, columns: DataFrame | None = None, keep_missing: bool = False) -> tuple[DataFrame, DataFrame]:
    """(model nodes, model edges): columns become data nodes, classes and statements class nodes; ids follow the node names.

    With ``keep_missing`` columns that the tree doesn't reach get data nodes as well; ``columns`` (table_id, col_index, name) gives labels.
    """
    touched = tree.select("table_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    used = nodes.join(touched, ["table_id", "node_id"], "left_semi")
    if keep_missing:
        used = used.unionByName(nodes.where(F.col("kind") == "column").join(touched, ["table_id", "node_id"], "left_anti"))
    kind = (
        F.when(F.col("kind") == "column", F.lit("data")).when(F.col("kind").isin("class", "statement", "entity"), F.lit("class")).when(F.col("kind") == "literal", F.lit("literal"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown kind "), "kind")).cast("string"))
    )
    number = F.row_number().over(Window.partitionBy("table_id").orderBy("node_id")) - 1
    sm = used.select("table_id", "node_id", number.alias("id"), kind.alias("kind"), "uri", "col_index")
    if columns is not None:
        sm = sm.join(columns.select("table_id", "col_index", F.col("name").alias("label")), ["table_id", "col_index"], "left")
    ids = sm.select("table_id", "node_id", "id")
    edges = tree.join(ids.toDF("table_id", "src", "source"), ["table_id", "src"]).join(ids.toDF("table_id", "dst", "target"), ["table_id", "dst"])
    return sm, edges.select("table_id", "source", "target", F.col("key").alias("uri"), F.lit(False).alias("approximation"))
