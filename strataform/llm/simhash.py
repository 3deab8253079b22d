"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, and connected components.

Two fingerprints of 64 bits that differ in at most r bits agree in one of r + 1 blocks of bits. For each block, the
fingerprints are dealt to shards by the block's value, so every link lies within some shard. A value that over ``HOT`` fingerprints
share is cut once more by blocks of the other bits, so shards stay small while a corpus has fewer fingerprints than 2**28 times ``SHARD``. A task builds the shard's BK-tree (children keyed by their
integer Hamming distance to the parent) and looks up the shard's fingerprints in it, following only edges within the radius
of a query's distance. Trees are thus brought to their queries by the shuffle: taken together they grow with the corpus, so they
have no size bound that would allow a broadcast. A shard beyond ``HOT`` is cut into parts, and each pair of parts is a task: tree of
one, queries of the other. Tasks return a spanning forest of the links they find, never all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, written
from .components import connected_components

SHARD, HOT, LEAF = 2048, 8192, 16
#: Sketches of ``similar_documents``, which only find most links cheaply: least hashes kept, bands and their rows; how far the estimate may lie under
#: the similarity asked for, and bits beyond the radius, as fingerprints spread around a similarity. PAIRS: pairs a task holds before it thins them. BINS: counts of shingles by hash.
#: Shingles that COMMON of about SAMPLE documents have come last in the order of the exact filter, at most MOST of them.
SKETCH, BANDS, ROWS, SLACK, SPREAD, PAIRS, BINS = 80, 10, 4, 0.08, 2, 1 << 21, 128
SAMPLE, COMMON, MOST, BATCH, QUERIES = 8192, 4, 100_000, 1 << 16, 64
#: Bits of the map of ids that pairs name, 2 MB whatever the corpus. Ids that share a bit cost a text sent in vain.
SLOTS = 1 << 24


def shingle_hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 with seed 42 of every run of ``words`` words (fewer words: of all of them; none: nothing)."""
    import xxhash

    found = (text or "").encode("utf-8").lower().split()  # bytes: A-Z alone, and ASCII white space
    if not found:
        return np.zeros(0, np.uint64)
    grams = list(map(b" ".join, zip(*(found[i:] for i in range(words))))) or [b" ".join(found)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, len(grams))


def fingerprint(hashes: np.ndarray) -> int:
    """64-bit fingerprint (unsigned): the bits set in over half of ``hashes``; 0 for none."""
    ones, step = np.zeros(64, np.int64), 1 << 16
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big") if len(hashes) else 0


def simhash(text: str | None, words: int = 3) -> int:
    """The fingerprint of a text's shingles."""
    return fingerprint(shingle_hashes(text, words))


class BkTree:
    """A BK-tree over distinct fingerprints; subtrees of at most ``LEAF`` items are lists. Built and walked with stacks, so any depth will do."""

    def __init__(self, items: np.ndarray):
        self.items = items.astype(np.uint64)
        #: A list of items, or (pivot, {distance: node}).
        self.nodes: list[np.ndarray | tuple[int, dict[int, int]]] = [np.arange(len(items))]
        todo = [0]
        while todo:
            at = todo.pop()
            own = self.nodes[at]
            if len(own) <= LEAF:
                continue
            pivot, rest = int(own[0]), own[1:]
            away = np.bitwise_count(self.items[rest] ^ self.items[pivot])
            order = np.argsort(away, kind="stable")
            keys, starts = np.unique(away[order], return_index=True)
            children = range(len(self.nodes), len(self.nodes) + len(keys))
            self.nodes += np.split(rest[order], starts[1:])
            self.nodes[at] = (pivot, dict(zip(keys.tolist(), children, strict=True)))
            todo += children

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (query index, item index) at ``radius`` or less, in blocks of at most ``LEAF`` times as many as queries; the queries walk the tree together."""
        queries = queries.astype(np.uint64)
        todo = [(0, np.arange(len(queries)))]
        while todo:
            at, live = todo.pop()
            node = self.nodes[at]
            if isinstance(node, np.ndarray):
                if len(node) and len(live):
                    q, t = np.nonzero(np.bitwise_count(queries[live][:, None] ^ self.items[node][None, :]) <= radius)
                    yield live[q], node[t]
                continue
            pivot, children = node
            away = np.bitwise_count(queries[live] ^ self.items[pivot]).astype(np.int16)
            near = live[away <= radius]
            yield near, np.full(len(near), pivot)
            for key, child in children.items():
                follow = live[np.abs(away - key) <= radius]
                if len(follow):
                    todo.append((child, follow))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest index in its component under the links a - b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Forest:
    """Components of ``n`` nodes under links that come in blocks: a label for each node, and ``PAIRS`` links or a block at most."""

    def __init__(self, n: int):
        self.label, self.a, self.b, self.held = np.arange(n), [], [], 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        new = a != b
        self.a.append(a[new])
        self.b.append(b[new])
        self.held += int(new.sum())
        if self.held > PAIRS:
            self.settle()

    def settle(self) -> np.ndarray:
        """The smallest index of each node's component."""
        if self.held:
            self.label = forest(len(self.label), np.concatenate(self.a), np.concatenate(self.b))[self.label]
        self.a, self.b, self.held = [], [], 0
        return self.label


def _links(radius: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", kind="stable")
        node, print_, part = (group[c].to_numpy() for c in ("node", "fp", "part"))
        print_ = print_.view(np.uint64)
        first = np.flatnonzero(part == part.min())
        other = np.flatnonzero(part == part.max())
        found = Forest(len(node))
        for q, t in BkTree(print_[first]).within(print_[other], radius):
            found.link(other[q], first[t])
        label = found.settle()
        moved = np.flatnonzero(label != np.arange(len(node)))
        return pd.DataFrame({"u": node[moved], "v": node[label[moved]]})

    return run


_ODD = np.random.default_rng(7).integers(1, 1 << 63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(hashes: np.ndarray) -> tuple[bytes, list[int]]:
    """(a byte for each of ``SKETCH`` permutations' least hash, a key for each of ``BANDS`` bands of ``ROWS`` of them)."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096, None] * _ODD[None, :]).min(axis=0), out=least)
    mixed = (least ^ (least >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in mixed[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return (mixed >> np.uint64(56)).astype(np.uint8).tobytes(), keys.view(np.int64).tolist()


def strongest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indices of links a - b among ``n`` nodes that connect what all of them connect, those of high ``weight`` first."""
    label, kept = np.arange(n), [np.zeros(0, np.int64)]
    for w in np.unique(weight)[::-1]:
        at = np.flatnonzero(weight == w)
        while True:
            x, y = label[a[at]], label[b[at]]
            at = at[x != y]
            if not len(at):
                break
            x, y = label[a[at]], label[b[at]]
            high, first = np.unique(np.maximum(x, y), return_index=True)  # each root hangs on a smaller one: no circles
            kept.append(at[first])
            up = np.arange(n)
            up[high] = np.minimum(x, y)[first]
            while (up[up] != up).any():
                up = up[up]
            label = up[label]
    return np.concatenate(kept)


class _Alike:
    """Pairs of rows whose fingerprints differ in ``radius`` bits at most and whose sketches agree in ``least`` bytes or more."""

    def __init__(self, prints: np.ndarray, sketches: np.ndarray, radius: int, least: float):
        self.prints, self.sketches, self.radius, self.least = prints, sketches, radius, least

    def pairs(self, queries: np.ndarray, rows: np.ndarray, tree: BkTree, of: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, equal bytes) in blocks; ``rows[of]`` are sorted by their place among the tree's fingerprints, which begin at ``first``."""
        sizes = np.diff(first)
        for q, t in tree.within(self.prints[queries], self.radius):
            ends = np.cumsum(sizes[t])
            at = 0
            while at < len(q):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH, side="right")))
                n = sizes[t[at:stop]]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                x, y = np.repeat(queries[q[at:stop]], n), rows[of[np.repeat(first[t[at:stop]], n) + step]]
                for cut in range(0, len(x), BATCH):  # one fingerprint may have more rows than that
                    u, v = x[cut : cut + BATCH], y[cut : cut + BATCH]
                    equal = (self.sketches[u] == self.sketches[v]).sum(axis=1)
                    ok = (equal >= self.least) & (u != v)
                    yield u[ok], v[ok], equal[ok].astype(np.uint8)
                at = stop

    def index(self, rows: np.ndarray) -> tuple[BkTree, np.ndarray, np.ndarray]:
        fps, place, sizes = np.unique(self.prints[rows], return_inverse=True, return_counts=True)
        return BkTree(fps), np.argsort(place, kind="stable"), np.concatenate([[0], np.cumsum(sizes)])

    def gather(self, rows: np.ndarray, take) -> np.ndarray:
        """One row of each group that links connect. ``take`` gets enough of the links; a row that is found is no query any more, so many rows alike cost a search each for the first few only."""
        if len(rows) < 2:
            return rows
        index, found, place = self.index(rows), Forest(len(rows)), np.empty(int(rows.max()) + 1, np.int64)
        place[rows] = np.arange(len(rows))
        left = np.ones(len(rows), bool)
        at = 0
        while at < len(rows):
            queries = at + np.flatnonzero(left[at : at + QUERIES])
            at += QUERIES
            left[queries] = False
            for x, y, equal in self.pairs(rows[queries], rows, *index) if len(queries) else ():
                take(x, y, equal)
                found.link(place[x], place[y])
                left[place[y]] = False
        return rows[np.unique(found.settle())]

    def across(self, one: np.ndarray, two: np.ndarray, take) -> None:
        if len(one) and len(two):
            for x, y, equal in self.pairs(two, one, *self.index(one)):
                take(x, y, equal)


def _similar(radius: int, least: float):
    """Links to be confirmed, among rows of one key: within a part, or between groups of two parts."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "part", "node"], kind="stable")
        node, print_, part, key = (group[c].to_numpy() for c in ("node", "fp", "part", "key"))
        alike = _Alike(print_.view(np.uint64), np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(node), -1), radius, least * SKETCH)
        # the same pair of rows may be in several bands, and a node in several rows: links go between nodes
        ids, index = np.unique(node, return_inverse=True)
        a, b, same, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)], [0]

        def take(x: np.ndarray, y: np.ndarray, equal: np.ndarray) -> None:
            a.append(index[x])
            b.append(index[y])
            same.append(equal)
            held[0] += len(x)
            if held[0] > PAIRS:
                thin()

        def thin() -> None:
            x, y, w = map(np.concatenate, (a, b, same))
            at = strongest(len(ids), x, y, w)
            a[:], b[:], same[:], held[0] = [x[at]], [y[at]], [w[at]], 0

        alone = part.min() == part.max()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1), len(key)]
        for lo, hi in zip(cuts, cuts[1:]):
            rows = np.arange(lo, hi)
            if alone:
                alike.gather(rows, take)
                continue
            low = part[lo:hi] == part.min()
            if low.any() and not low.all():  # links within a part are that part's own task
                alike.across(*(alike.gather(rows[x], lambda *_: None) for x in (low, ~low)), take)
        thin()
        return pd.DataFrame({"u": ids[np.maximum(a[0], b[0])], "v": ids[np.minimum(a[0], b[0])]})

    return run


def prefix_length(n: int, similarity: float) -> int:
    """So many first shingles, in one order for all, of a set of ``n``: sets with that Jaccard similarity have one of them in common."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def bins(hashes: np.ndarray) -> bytes:
    """How many of distinct ``hashes`` have each value of seven bits, to 255. Two sets differ in at least the sum of the differences."""
    return np.minimum(np.bincount((hashes >> np.uint64(20)).astype(np.int64) % BINS, minlength=BINS), 255).astype(np.uint8).tobytes()


def fine_bins(hashes: np.ndarray) -> bytes:
    """As ``bins``, with as many bins (a power of two) as leave 8 to 16 hashes in one: in few bins, long texts have like counts whatever they say."""
    size = max(BINS, 1 << max(0, (len(hashes) // 8).bit_length() - 1))
    return np.minimum(np.bincount((hashes >> np.uint64(20)).astype(np.int64) % size, minlength=size), 255).astype(np.uint8).tobytes()


def apart(one: bytes, two: bytes) -> int:
    """In how many hashes two sets differ at least, by their ``fine_bins``; the longer is folded."""
    x, y = (np.frombuffer(b, np.uint8).astype(np.int64) for b in (one, two))
    size = min(len(x), len(y))
    return int(np.abs(x.reshape(-1, size).sum(axis=0) - y.reshape(-1, size).sum(axis=0)).sum())


def not_apart(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (u, v) of nodes whose sizes and fine bins allow ``similarity``: none that has it is lost, and most others cost no text."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        u, v = [], []
        for one, two, n, m, x, y in zip(*(batch[c] for c in ("u", "v", "n", "m", "x", "y"))):
            if apart(x, y) * (1 + similarity) <= (1 - similarity) * (n + m) + 1e-6:
                u.append(one)
                v.append(two)
        return {"u": u, "v": v}

    of = lambda node, n, fine: nodes.select(F.col("node").alias(node), F.col("n").alias(n), F.col("fine").alias(fine))
    asked = written(pairs.distinct(), "proposed").join(of("u", "n", "x"), "u").join(of("v", "m", "y"), "v").select("u", "v", "n", "m", "x", "y")
    return map_arrow(asked, run, "u long, v long", pa.schema([("u", pa.int64()), ("v", pa.int64())]))


def common_shingles(df: DataFrame, text: str, words: int) -> np.ndarray:
    """Hashes, sorted, of shingles found in ``COMMON`` documents of a sample. What it misses costs time only: any order of shingles is exact."""
    some = max(1, df.count() // SAMPLE)

    def run(batch: dict[str, list]) -> dict[str, list]:
        return {"h": np.concatenate([np.zeros(0, np.uint64), *(np.unique(shingle_hashes(t, words)) for t in batch[text])]).view(np.int64)}

    texts = df.select(text).where(F.pmod(F.xxhash64(text), F.lit(some)) == 0).distinct()
    seen = map_arrow(texts, run, "h long", pa.schema([("h", pa.int64())])).groupBy("h").count().where(f"count >= {COMMON}")
    found = [r.h for r in seen.orderBy(F.desc("count"), "h").limit(MOST).select("h").collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _crossing(similarity: float):
    """Pairs of nodes of different components that share a row's ``key`` and whose sizes, places in the order and bins allow ``similarity``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", kind="stable")
        key, node, comp, n, pos, part = (group[c].to_numpy() for c in ("key", "node", "comp", "n", "pos", "part"))
        counts = np.frombuffer(b"".join(group["bins"]), np.uint8).reshape(len(node), BINS).astype(np.int16)
        low, high = part == part.min(), part == part.max()
        found = [np.zeros((0, 2), np.int64)]
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1), len(key)]
        for lo, hi in zip(cuts, cuts[1:]):
            first, other = lo + np.flatnonzero(low[lo:hi]), lo + np.flatnonzero(high[lo:hi])
            step = max(1, (1 << 20) // max(1, len(first)))
            for at in range(0, len(other), step):
                x, y = other[at : at + step, None], first[None, :]
                # the first shingle two sets have in common is their ``key`` in some row: what follows it bounds the rest
                common = np.minimum(n[x] - pos[x], n[y] - pos[y])
                ok = (comp[x] != comp[y]) & (common * (1 + similarity) >= similarity * (n[x] + n[y]) - 1e-6)
                q, t = np.nonzero(ok)
                q, t = x[q, 0], y[0, t]
                apart = [np.abs(counts[q[i : i + 8192]] - counts[t[i : i + 8192]]).sum(axis=1) for i in range(0, len(q), 8192)]
                near = np.concatenate([np.zeros(0, np.int64), *apart]) * (1 + similarity) <= (1 - similarity) * (n[q] + n[t]) + 1e-6
                q, t = node[q[near]], node[t[near]]
                found.append(np.stack([np.maximum(q, t), np.minimum(q, t)], axis=1))
            if sum(map(len, found[1:])) > PAIRS:
                found = [np.unique(np.concatenate(found), axis=0)]
        pairs = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    return run


def named_in(texts: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose ``key`` is an end of ``pairs`` (u, v), and a few others: sorted out by a map of bits before anything is shuffled."""
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)) + 1
    ends = pairs.select(F.explode(F.array("u", "v")).alias("end")).select(at("end").alias("at"))
    bits = ends.groupBy(F.bitmap_bucket_number("at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits"))
    placed = texts.withColumn("__bucket", F.bitmap_bucket_number(at(key))).withColumn("__bit", F.bitmap_bit_position(at(key)))
    is_set = F.expr("shiftright(cast(conv(hex(substring(__bits, cast(__bit div 8 as int) + 1, 1)), 16, 10) as int), cast(__bit % 8 as int)) & 1 = 1")
    return placed.join(F.broadcast(bits), "__bucket").where(is_set).select(*texts.columns)


def confirmed(pairs: DataFrame, df: DataFrame, key: str, text: str, words: int, similarity: float) -> DataFrame:
    """The ``pairs`` (u, v) of keys of ``df`` whose texts have a Jaccard similarity of ``similarity`` or more in their distinct shingles."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        u, v = [], []
        for one, two, x, y in zip(batch["u"], batch["v"], batch["x"], batch["y"]):
            x, y = np.unique(shingle_hashes(x, words)), np.unique(shingle_hashes(y, words))
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common >= similarity * (len(x) + len(y) - common) - 1e-9:
                u.append(one)
                v.append(two)
        return {"u": u, "v": v}

    pairs = written(pairs.distinct(), "pairs")  # so the files of the search are gone before texts move
    texts = lambda name, to: named_in(df.select(F.col(key).cast("long").alias(name), F.col(text).alias(to)), name, pairs)
    asked = pairs.join(texts("u", "x"), "u").join(texts("v", "y"), "v").select("u", "v", "x", "y")
    return map_arrow(asked, run, "u long, v long", pa.schema([("u", pa.int64()), ("v", pa.int64())]))


def similar_documents(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``key`` and component_id of documents that are alike: linked where the Jaccard similarity of their distinct shingles is ``similarity`` or more.

    SimHash proposes most links cheaply: texts that share a band of least hashes are searched in BK-trees of their fingerprints. Links that
    sketches miss come from an exact filter: two sets that similar share one of the first ``prefix_length`` shingles of each in one order, here by
    hash with common ones last. Only pairs between components found so far are taken from it, so a group of alike texts gives none. ``df`` is read several
    times. Null and empty texts are alike; null keys have a null component_id unless a row with a key has equal shingles.
    """
    radius = int(64 * (1 - similarity) + 1e-9) + SPREAD
    late = np.append(common_shingles(df, text, words), np.uint64(0))  # the last place is for hashes beyond all others

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"key": batch[key], **{c: [] for c in ("digest", "n", "bins", "fine", "fp", "sketch", "bands", "prefix")}}
        for t in batch[text]:
            hashes = shingle_hashes(t, words)
            own = np.unique(hashes)
            packed, bands = sketch(own)
            out["digest"].append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            out["n"].append(len(own))
            out["bins"].append(bins(own))
            out["fine"].append(fine_bins(own))
            out["fp"].append(fingerprint(hashes))
            out["sketch"].append(packed)
            out["bands"].append(bands)
            out["prefix"].append(own[np.argsort(late[np.searchsorted(late[:-1], own)] == own, kind="stable")][: prefix_length(len(own), similarity)].view(np.int64))
        out["fp"] = np.array(out["fp"], np.uint64).view(np.int64)
        return out

    arrow = pa.schema([
        ("key", pa.int64()), ("digest", pa.binary()), ("n", pa.int32()), ("bins", pa.binary()), ("fine", pa.binary()), ("fp", pa.int64()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())),
    ])
    kinds = "key long, digest binary, n int, bins binary, fine binary, fp long, sketch binary, bands array<long>, prefix array<long>"
    rows = map_arrow(df.select(F.col(key).cast("long").alias(key), text), run, kinds, arrow)
    prints = written(rows.withColumnRenamed("key", key), "sketches")
    nodes = written(prints.groupBy("digest").agg(F.min(key).alias("node"), *(F.min(c).alias(c) for c in ("n", "bins", "fine", "fp", "sketch", "bands", "prefix"))).where("node is not null"), "nodes")
    digests = written(prints.select(key, "digest"), "digests")
    discard(prints)

    # most bands are some text's own: only those that two nodes share are sent with sketches
    bands = nodes.select("digest", "node", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select(F.col("key").bitwiseXOR(F.lit(0).cast("long")).alias("shared"))
    kept = bands.join(shared, bands["key"] == shared["shared"]).select(F.col("digest").alias("of"), "key")
    keyed = written(nodes.select("digest", "node", "fp", "sketch").join(kept, F.col("digest") == F.col("of")).select("node", "fp", "sketch", "key"), "bands")
    shards = max(1, -(-keyed.count() // SHARD))
    paired = _dealt(keyed.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))), ["shard"], "node")
    links = paired.groupBy("shard", "lo", "hi").applyInPandas(_similar(radius, similarity - SLACK), "u long, v long")
    roots = connected_components(confirmed(links, df, key, text, words, similarity))

    known = nodes.join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("comp"), F.posexplode("prefix").alias("pos", "key"))
    mixed = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(F.col("key").bitwiseXOR(F.lit(0).cast("long")).alias("mixed"))
    crossing = known.join(mixed, known["key"] == mixed["mixed"]).drop("mixed")
    crossing = written(crossing.join(nodes.select(F.col("node").alias("whose"), "bins"), F.col("node") == F.col("whose")).drop("whose"), "crossing")
    shards = max(1, -(-crossing.count() // SHARD))
    paired = _dealt(crossing.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))), ["shard"], "node")
    pairs = paired.groupBy("shard", "lo", "hi").applyInPandas(_crossing(similarity), "u long, v long")
    more = confirmed(not_apart(pairs, nodes, similarity), df, key, text, words, similarity)
    roots = connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
    named = nodes.join(roots, "node", "left").select(F.col("digest").alias("d"), F.coalesce("root", "node").alias("component_id"))
    return digests.join(named, digests["digest"] == named["d"], "left").select(key, "component_id")


def _dealt(keyed: DataFrame, by: list[str], spread: str) -> DataFrame:
    """Rows of shards, with part, lo, hi: shards beyond ``HOT`` are cut into parts, and each row goes to every pair of parts that has its own."""
    sizes = keyed.groupBy(*by).count().where(f"count > {HOT}")
    # fresh expressions, so the join gets exchanges of its own where it isn't a broadcast
    hot = sizes.select(*(F.col(c).cast("string").cast("long").alias(f"hot_{c}") for c in by), F.ceil(F.col("count") / HOT).cast("int").alias("parts"))
    same = [keyed[c].cast("long") == hot[f"hot_{c}"] for c in by]
    dealt = keyed.join(hot, same, "left").select(*keyed.columns, F.coalesce("parts", F.lit(1)).alias("parts"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(spread, F.lit("part")), F.col("parts")).cast("int"))
    paired = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return paired.withColumn("lo", F.least("part", "with")).withColumn("hi", F.greatest("part", "with")).drop("parts", "with")


def fingerprint_links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Links (u, v) between ``nodes`` (node long, fp long, both without repeats) whose fps differ in at most ``radius`` bits.

    Not all pairs: in each task's set of links, enough to connect what they connect. ``nodes`` is read several times.
    """
    blocks = radius + 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    bits = lambda fp, lo, hi: F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))
    values = F.array(*(bits("fp", lo, hi) for lo, hi in zip(edges, edges[1:])))
    keyed = nodes.select("node", "fp", F.posexplode(values).alias("block", "value"))
    # fingerprints that agree in a frequent block differ in the other bits only, so these are cut into blocks likewise
    sizes = keyed.groupBy("block", "value").count().where(f"count > {HOT}")
    often = sizes.select(F.col("block").cast("string").cast("int").alias("of"), F.col("value").cast("string").cast("long").alias("such"))
    known = keyed.join(often, (F.col("block") == F.col("of")) & (F.col("value") == F.col("such")), "left")
    turned = F.lit(0).cast("long")
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):  # the block's bits on top
        up = 64 - hi
        turned = F.when(F.col("block") == i, F.shiftleft("fp", up).bitwiseOR(F.shiftrightunsigned("fp", 64 - up)) if up else F.col("fp")).otherwise(turned)
    rest = min(64 - (hi - lo) for lo, hi in zip(edges, edges[1:]))
    cuts = [rest * i // blocks for i in range(blocks)] + [64 - min(hi - lo for lo, hi in zip(edges, edges[1:]))]
    below = F.array(*(F.struct(F.lit(i).alias("sub"), bits("turned", lo, hi).alias("more")) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))))
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("more")))
    split = known.withColumn("turned", turned).select("node", "fp", "block", "value", F.inline(F.when(F.col("of").isNotNull(), below).otherwise(whole)))
    shards = max(1, -(-nodes.count() // SHARD))
    dealt = split.select("node", "fp", "block", "sub", F.pmod(F.xxhash64("block", "value", "sub", "more"), F.lit(shards)).alias("shard"))
    paired = _dealt(dealt, ["block", "sub", "shard"], "fp")
    return paired.groupBy("block", "sub", "shard", "lo", "hi").applyInPandas(_links(radius), "u long, v long")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``key`` (as long) and ``fp``: the fingerprint of each row's text, as a signed long. Null texts count as empty."""

    def run(batch: dict[str, list]) -> dict[str, list]:
        prints = np.array([simhash(t, words) for t in batch[text]], np.uint64).view(np.int64)
        return {"key": batch[key], "fp": prints}

    arrow = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
    return map_arrow(df.select(F.col(key).cast("long").alias(key), text), run, "key long, fp long", arrow).withColumnRenamed("key", key)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """Per row of ``df``: ``key``, fingerprint (16 hex digits) and component_id, the smallest key reachable over links.

    Null and empty texts have fingerprint zero and link like any other. A row with a null key has the component of its
    fingerprint if a row with a key shares it, else null. Repeated rows give repeated rows; an empty table none.
    """
    prints = written(fingerprints(df, key, text, words), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min(key).alias("node")).where("node is not null"), "nodes")
    roots = connected_components(fingerprint_links(nodes, radius))
    named = nodes.join(roots, "node", "left").select(F.col("fp").alias("print"), F.coalesce("root", "node").alias("component_id"))
    joined = prints.join(named, prints["fp"] == named["print"], "left")
    return joined.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
