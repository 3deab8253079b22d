"""Exact top-k by inner product with dual cover trees.

The top of the tree over all rows is grown on the driver from a bounded sample: ``PIVOTS`` centres at most, farthest first. Every row is dealt to its
nearest pivot; a pivot's covering radius is measured over all of its rows, so bounds hold whatever the sample was. A pivot with
many rows (copies of one vector, say) is cut into parts by a hash of the id. Then, in two rounds:

1. Each query meets one part of its own pivot. Its worst k-th score there holds in the second round, too.
2. A query goes on to the parts of those pivots whose bound reaches that score, in blocks of queries, so no task holds all queries or all rows.

In a task, cover trees are grown over the rows and over the queries, and pairs of their nodes are visited best bound first. With centres a and b,
covering radii r and s, and the greatest norms A and B below, no pair scores over ``<a, b> + |a| s + |b| r + r s``, nor over
``(A^2 + B^2 - max(0, |a - b| - r - s)^2) / 2``. A pair of nodes is dropped when that lies under the worst k-th score of the query group.
Scores are exact: sums of doubles while all products stay below 2**53, else of 64-bit integers.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a leaf; rows of the sample and pivots grown from it; rows of a part and queries of a block at most; parts a table is cut into at least, if they have LEAST rows.
LEAF, SAMPLE, PIVOTS, ROWS, BLOCK, PARTS, LEAST = 48, 2048, 64, 32768, 32768, 16, 1024
#: Vectors whose scaled norm reaches this are refused: their scores might not fit 64 bits.
NORM = 2.0**31


def farthest_first(points: np.ndarray, square: np.ndarray, first: int, away: np.ndarray, reach: float, most: int, slack: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray] | None:
    """Centres over ``reach`` apart that cover all ``points`` within ``reach``: (centres, index of each point's nearest, its distance).

    ``first`` is the first centre, ``away`` the distances to it. None if that takes more than ``most`` centres.
    """
    centres, owner, nearest = [first], np.zeros(len(points), np.int64), away.copy()
    while nearest.max() > reach:
        if len(centres) == most:
            return None
        far = int(nearest.argmax())
        step = distances(points, points[far], slack, square)
        closer = step < nearest
        owner[closer], nearest[closer] = len(centres), step[closer]
        centres.append(far)
    return centres, owner, nearest


def distances(points: np.ndarray, centre: np.ndarray, slack: float, square: np.ndarray | None = None) -> np.ndarray:
    """Euclidean distances, raised by what rounding may have taken (``slack`` of the squared norms, which ``square`` may give; 0 where sums are exact)."""
    square, own = (points**2).sum(axis=1) if square is None else square, float(centre @ centre)
    return np.sqrt(np.maximum(square + own - 2 * (points @ centre), 0) + slack * (square + own))


class CoverTree:
    """Nodes in arrays: the point at the centre, covering radius, greatest norm, children, and for leaves the rows.

    Nesting: a node's centre is its first child's centre. Covering: all rows of a child lie within half the node's radius of the child's
    centre. Separation: the children's centres are over half the node's radius apart. A node that ``rows / LEAF`` (at least 64, but half the rows at most) such children don't
    cover has no structure to prune by (vectors of many independent dimensions are like that) and stays a leaf.
    """

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float64)
        self.slack = 0.0 if not len(points) or float(np.abs(points).max()) ** 2 * points.shape[1] * 4 < 2**53 else 1e-14 * points.shape[1]
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.most: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray | None] = []
        self.norm = np.linalg.norm(self.points, axis=1) * (1 + 1e-12)
        self.square = (self.points**2).sum(axis=1)
        self.root = self._grow() if len(points) else -1

    def _add(self, own: np.ndarray, centre: int, away: np.ndarray) -> int:
        self.centre.append(centre)
        self.radius.append(float(away.max()))
        self.most.append(float(self.norm[own].max()))
        self.children.append([])
        self.rows.append(own)
        return len(self.centre) - 1

    def _grow(self) -> int:
        every = np.arange(len(self.points))
        middle = int(distances(self.points, self.points.mean(axis=0), 0).argmin())
        away = distances(self.points, self.points[middle], self.slack)
        root = self._add(every, middle, away)
        todo = [(root, away)]
        while todo:
            node, away = todo.pop()
            own, reach = self.rows[node], self.radius[node]
            if len(own) <= LEAF or reach <= 1e-5 * self.norm[self.centre[node]]:
                continue
            first = int(np.flatnonzero(own == self.centre[node])[0])
            found = farthest_first(self.points[own], self.square[own], first, away, reach / 2, min(max(64, len(own) // LEAF), len(own) // 2), self.slack)
            if found is None:
                continue
            centres, owner, nearest = found
            self.rows[node] = None
            for k, c in enumerate(centres):
                mine = np.flatnonzero(owner == k)
                child = self._add(own[mine], int(own[c]), nearest[mine])
                self.children[node].append(child)
                todo.append((child, nearest[mine]))
        return root


def bounds(inner: np.ndarray, apart: np.ndarray, norm_a, norm_b, r, s, most_a, most_b) -> np.ndarray:
    """No pair of rows below two nodes scores more, by their centres' inner product and distance, norms, radii and greatest norms; with room for rounding."""
    ball = inner + norm_a * s + norm_b * r + r * s
    chord = (most_a**2 + most_b**2 - np.maximum(apart - r - s, 0) ** 2) / 2
    top = np.minimum(ball, chord)
    return top + 1e-6 * (1 + np.abs(top)) + 1e-9 * most_a * most_b


class TopK:
    """The k best (score, then smaller id) of each query so far, and how many pairs were scored."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None):
        self.k, self.scored = k, 0
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.least = np.full(n, np.iinfo(np.int64).min) if least is None else least

    def worst(self, queries: np.ndarray) -> np.ndarray:
        """The score that a row needs to count for each query."""
        return np.maximum(self.score[queries, -1], self.least[queries])

    def offer(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores[i, j]`` of candidate ``ids[j]`` for ``queries[i]``; the least integer stands for no candidate."""
        self.scored += scores.size
        need = np.maximum(self.worst(queries), np.iinfo(np.int64).min + 1)
        good = scores >= need[:, None]
        if np.count_nonzero(good) > 2 * self.k * len(queries) and scores.shape[1] > self.k:
            good &= scores >= np.partition(scores, -self.k, axis=1)[:, -self.k][:, None]
        i, j = np.nonzero(good)
        if not len(i):
            return
        touched = np.unique(i)
        owner = np.concatenate([i, np.repeat(touched, self.k)])
        score = np.concatenate([scores[i, j], self.score[queries[touched]].ravel()])
        own = np.concatenate([ids[j], self.id[queries[touched]].ravel()])
        order = np.lexsort((own, ~score, owner))
        owner = owner[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        keep = place < self.k
        self.score[queries[owner[keep]], place[keep]] = score[order][keep]
        self.id[queries[owner[keep]], place[keep]] = own[order][keep]


def search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, least: np.ndarray | None = None) -> TopK:
    """Dual-tree search of integer vectors; a row is no candidate for the query with its own id. Scores under ``least`` of a query don't matter."""
    best = TopK(len(queries), k, least)
    if not len(queries) or not len(rows):
        return best
    small = float(np.abs(queries).max()) * float(np.abs(rows).max()) * rows.shape[1] < 2**53
    q, t = CoverTree(queries), CoverTree(rows)
    left, right = (q.points, t.points) if small else (queries, rows)
    worst = np.full(len(q.centre), -np.inf)  # of each query node, raised from the leaves when asked

    def bound(a: int, b: int) -> float:
        x, y = q.points[q.centre[a]], t.points[t.centre[b]]
        return float(bounds(x @ y, np.linalg.norm(x - y), q.norm[q.centre[a]], t.norm[t.centre[b]], q.radius[a], t.radius[b], q.most[a], t.most[b]))

    def kth(a: int) -> float:
        own = q.rows[a]
        worst[a] = best.worst(own).min() if own is not None else max(worst[a], min(worst[c] for c in q.children[a]))
        return worst[a]

    for a in range(len(q.centre) - 1, -1, -1):  # children come after their parent
        kth(a)
    heap = [(-bound(q.root, t.root), q.root, t.root)]
    while heap:
        top, a, b = heapq.heappop(heap)
        if -top < kth(a):
            continue
        if q.rows[a] is not None and t.rows[b] is not None:
            for at in range(0, len(q.rows[a]), 2048):
                mine = q.rows[a][at : at + 2048]
                for start in range(0, len(t.rows[b]), 2048):
                    theirs = t.rows[b][start : start + 2048]
                    scores = (left[mine] @ right[theirs].T).astype(np.int64)
                    scores[query_ids[mine][:, None] == row_ids[theirs][None, :]] = np.iinfo(np.int64).min
                    best.offer(mine, row_ids[theirs], scores)
            continue
        # the wider node is opened
        if t.rows[b] is None and (q.rows[a] is not None or t.radius[b] >= q.radius[a]):
            pairs = [(a, c) for c in t.children[b]]
        else:
            pairs = [(c, b) for c in q.children[a]]
        for x, y in pairs:
            up = bound(x, y)
            if up >= worst[x]:
                heapq.heappush(heap, (-up, x, y))
    return best


def packed(x: np.ndarray) -> bytes:
    """Integers in the least width of 2, 4 or 8 bytes that holds them."""
    top = np.abs(x).max()
    return x.astype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8").tobytes()


def unpacked(vectors: list[bytes], dim: int) -> np.ndarray:
    """Rows of ``packed`` as a matrix of 64-bit integers."""
    out, widths = np.empty((len(vectors), dim), np.int64), np.array([len(v) // dim for v in vectors])
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        out[at] = np.frombuffer(b"".join(vectors[i] for i in at), f"<i{w}").reshape(-1, dim)
    return out


def quantized(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``key`` (long), ``dim`` and ``v``: floor(scale * x) of each component as ``packed`` integers.

    Rows with a null key or vector, or with a null or non-finite component, are left out; so are empty vectors. A scaled norm of
    ``NORM`` or more raises an error.
    """

    def run(batches):
        for batch in batches:
            ids, dims, out = [], [], []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k is None or not v or None in v or not np.isfinite(v).all():
                    continue
                x = np.floor(np.array(v, np.float64) * scale)
                if not np.abs(x).max() < NORM or np.linalg.norm(x) >= NORM:
                    raise ValueError(f"vector of {k}: its scores may not fit 64 bits")
                ids.append(k)
                dims.append(len(v))
                out.append(packed(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=[key, "dim", "v"])

    return df.select(F.col(key).cast("long").alias(key), vector).mapInArrow(run, f"`{key}` long, dim int, v binary")


def grow_pivots(sample: pd.DataFrame, most: int) -> dict[int, np.ndarray]:
    """For each dimension the vectors of up to ``most`` pivots, farthest first."""
    out = {}
    for dim, part in sample.groupby("dim"):
        points = unpacked(list(part["v"]), int(dim)).astype(np.float64)
        first = int(distances(points, points.mean(axis=0), 0).argmin())
        centres, nearest = [first], distances(points, points[first], 0)
        while len(centres) < most and nearest.max() > 0:
            centres.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, distances(points, points[centres[-1]], 0))
        out[int(dim)] = points[centres]
    return out


def assigned(rows: DataFrame, pivots: dict[int, np.ndarray], key: str) -> DataFrame:
    """Add the nearest ``pivot`` of each row's dimension, the distance ``away`` and the ``norm``; without pivots (a dimension the sample missed) that is the origin, -1."""

    def run(batches):
        for batch in batches:
            dims, vectors = batch.column(1).to_numpy(), batch.column(2).to_pylist()
            pivot, away, norm = np.full(len(dims), -1, np.int32), np.zeros(len(dims)), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = unpacked([vectors[i] for i in at], int(dim)).astype(np.float64)
                norm[at] = away[at] = np.linalg.norm(x, axis=1) * (1 + 1e-12)
                if int(dim) in pivots:
                    c = pivots[int(dim)]
                    pivot[at] = nearest = ((c**2).sum(axis=1)[None, :] - 2 * (x @ c.T)).argmin(axis=1)
                    away[at] = np.linalg.norm(x - c[nearest], axis=1) * (1 + 1e-12)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(away), pa.array(norm)], names=[*batch.schema.names, "pivot", "away", "norm"])

    return rows.mapInArrow(run, f"`{key}` long, dim int, v binary, pivot int, away double, norm double")


def _searched(key: str, k: int):
    """A task of one round: queries (with the scores they have to reach) and rows of one dimension."""

    def run(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})
        dim, ids, row_ids = int(mine["dim"].iloc[0]), mine[key].to_numpy(np.int64), theirs[key].to_numpy(np.int64)
        found = search(unpacked(list(mine["v"]), dim), ids, unpacked(list(theirs["v"]), dim), row_ids, k, mine["least"].to_numpy(np.int64))
        i, j = np.nonzero(found.id != np.iinfo(np.int64).max)
        return pd.DataFrame({"query_id": ids[i], "vec_id": found.id[i, j], "score": found.score[i, j]})

    return run


def _open_parts(x: np.ndarray, worst: np.ndarray, own: pd.DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, pivot, part) of all parts whose pivot's bound reaches a query's worst k-th score."""
    norm = np.linalg.norm(x, axis=1)[:, None] * (1 + 1e-12)
    apart = np.stack([np.linalg.norm(x - c, axis=1) for c in centres], axis=1)
    reach, most = (own[c].to_numpy()[None, :] for c in ("reach", "most"))
    top = bounds(x @ centres.T, apart, norm, np.linalg.norm(centres, axis=1)[None, :], 0.0, reach, norm, most)
    i, j = np.nonzero(top >= worst.astype(np.float64)[:, None])
    parts = own["parts"].to_numpy()[j]
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(i, parts), np.repeat(own["pivot"].to_numpy()[j], parts), number


def top_k_search(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The ``k`` rows with the highest integer inner product for each query row: query_id, rank (from 1), vec_id, score.

    Queries are the rows of ``df`` that pass ``is_query`` (a condition on ``key``); a query's own id is no candidate for it, ties
    go to the smaller id, and with fewer candidates than ``k`` all are returned. Rows of equal id are each a candidate
    for others; as a query such an id counts once, with its least vector. Vectors that are null, empty, or hold null or non-finite components take no
    part; vectors meet those of their own dimension only. Finite vectors so large that a score might not fit 64 bits raise an error.
    On the driver: the sample, and one row for each dimension and pivot.
    """
    quantities, n = quantized(df, key, vector, scale), df.count()
    size = min(ROWS, max(LEAST, -(-n // PARTS)))
    sample = quantities.orderBy(F.xxhash64(key), key, "dim", "v").limit(SAMPLE).select("dim", "v").toPandas()
    pivots = grow_pivots(sample, min(PIVOTS, max(1, n // size)))
    rows = written(assigned(quantities, pivots, key), "vectors")
    spread = lambda parts, salt: F.pmod(F.xxhash64(key, F.lit(salt)), parts).cast("int")
    met = rows.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.max("away").alias("reach"), F.max("norm").alias("most")).orderBy("dim", "pivot").toPandas()
    met["parts"] = -(-met["n"] // size)
    if met.empty:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts_of = F.element_at(F.create_map(*(F.lit(x) for r in met.itertuples() for x in (f"{r.dim}:{r.pivot}", int(r.parts)))), F.concat_ws(":", "dim", "pivot"))
    table = rows.withColumn("part", spread(parts_of, "part")).select(key, "dim", "v", "pivot", "part")
    asked = rows.where(is_query).groupBy(key).agg(F.min(F.struct("dim", "v", "pivot")).alias("q")).select(key, "q.*")
    asked = asked.withColumn("part", spread(parts_of, "first")).withColumn("least", F.lit(np.iinfo(np.int64).min))
    home = ["dim", "pivot", "part"]
    found = "query_id long, vec_id long, score long"
    first = written(asked.groupBy(*home).cogroup(table.groupBy(*home)).applyInPandas(_searched(key, k), found), "first")

    worst = first.groupBy("query_id").agg(F.min("score").alias("worst"), F.count("*").alias("had")).where(F.col("had") >= k)
    bar = asked.drop("least").join(worst, F.col(key) == F.col("query_id"), "left").withColumn("least", F.coalesce("worst", F.lit(np.iinfo(np.int64).min))).drop("query_id", "worst", "had")
    by_dim = {int(dim): part for dim, part in met.groupby("dim")}
    centres = {dim: np.stack([pivots[dim][p] if p >= 0 else np.zeros(dim) for p in own["pivot"]]) for dim, own in by_dim.items()}

    def onward(batches):
        for batch in batches:
            for at in range(0, len(batch), 1024):
                few = batch.slice(at, 1024)
                dims, worst, pivot, part = (few.column(few.schema.get_field_index(c)).to_numpy() for c in ("dim", "least", "pivot", "part"))
                vectors = few.column(few.schema.get_field_index("v")).to_pylist()
                for dim in map(int, np.unique(dims)):
                    at_dim = np.flatnonzero(dims == dim)
                    i, to, number = _open_parts(unpacked([vectors[q] for q in at_dim], dim).astype(np.float64), worst[at_dim], by_dim[dim], centres[dim])
                    away = (to != pivot[at_dim[i]]) | (number != part[at_dim[i]])
                    i, to, number = at_dim[i[away]], to[away], number[away]
                    for start in range(0, len(i), 16384):
                        cut = slice(start, start + 16384)
                        kept = [few.column(few.schema.get_field_index(c)).take(pa.array(i[cut])) for c in (key, "v", "least")]
                        goes = [pa.array(x.astype(np.int32)) for x in (np.full(len(i[cut]), dim), to[cut], number[cut])]
                        yield pa.RecordBatch.from_arrays([*goes, *kept], names=[*home, key, "v", "least"])

    blocks = max(1, -(-asked.count() // BLOCK))
    meet = [*home, "block"]
    queries = bar.mapInArrow(onward, f"dim int, pivot int, part int, `{key}` long, v binary, least long").withColumn("block", spread(F.lit(blocks), "block"))
    queries = written(queries, "queries")
    wanted = queries.select(*(F.col(c).cast("long").alias(f"to_{c}") for c in meet)).distinct()
    same = [table[c].cast("long") == wanted[f"to_{c}"] for c in home]
    copies = table.join(wanted, same).select(*table.columns, F.col("to_block").cast("int").alias("block"))
    second = queries.groupBy(*meet).cogroup(copies.groupBy(*meet)).applyInPandas(_searched(key, k), found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
