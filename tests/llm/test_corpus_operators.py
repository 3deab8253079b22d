"""Operators over the whole corpus: top-k, near-duplicates, repeats, lines, the pipeline."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataform.llm import components, covertree, line_dedup, quality, simhash, suffix_dedup
from strataform.llm.common import fold


def brute_top(ids, x, query, k):
    out = {}
    for i in np.flatnonzero(query):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), int(s[j])) for j in order]
    return out


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 300), st.integers(1, 6), st.sampled_from([1, 3, 50]))
def test_dual_tree_against_brute_force(seed, n, dim, width):
    r = np.random.default_rng(seed)
    x = r.integers(-width, width + 1, (n, dim))
    ids = r.permutation(n * 2)[:n]
    query = ids % 5 == 0
    best = covertree.search(x[query], ids[query], x, ids, 5)
    want = brute_top(ids, x, query, 5)
    for i, k in enumerate(ids[query]):
        assert [(int(a), int(b)) for a, b in zip(best.id[i], best.score[i]) if a != np.iinfo(np.int64).max] == want[int(k)]


@pytest.mark.parametrize("scale", [1, 1 << 20, 1 << 28])
def test_cover_tree_is_one(scale):
    """Nesting, covering and separation, and every row in one leaf; also where distances are rounded."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.integers(0, 40, (40, 3))[r.integers(0, 40, 3000)] * 1000 + r.integers(-30, 31, (3000, 3)), np.full((200, 3), 7)]) * scale
    tree = covertree.CoverTree(x)

    def below(node):
        return tree.rows[node] if tree.rows[node] is not None else np.concatenate([below(c) for c in tree.children[node]])

    inner = [n for n in range(len(tree.centre)) if tree.children[n]]
    assert len(inner) > 10
    for node in range(len(tree.centre)):
        assert np.linalg.norm(tree.points[below(node)] - tree.points[tree.centre[node]], axis=1).max() <= tree.radius[node] * (1 + 1e-9)
    for node in inner:
        centres = [tree.centre[c] for c in tree.children[node]]
        assert centres[0] == tree.centre[node]
        assert all(tree.radius[c] <= tree.radius[node] / 2 for c in tree.children[node])
        apart = [np.linalg.norm(tree.points[a] - tree.points[b]) for i, a in enumerate(centres) for b in centres[:i]]
        assert min(apart) > tree.radius[node] / 2 * (1 - 1e-6)
    assert sorted(below(tree.root)) == list(range(len(x)))


def test_dual_tree_prunes_clusters():
    r = np.random.default_rng(4)
    centres = r.normal(size=(60, 16))
    x = np.round(400 * (centres / np.linalg.norm(centres, axis=1)[:, None])[r.integers(0, 60, 6000)] + r.normal(size=(6000, 16)) * 4).astype(np.int64)
    ids = np.arange(6000)
    best = covertree.search(x[::50], ids[::50], x, ids, 5)
    want = brute_top(ids, x, ids % 50 == 0, 5)
    assert {int(q): [(int(a), int(b)) for a, b in zip(best.id[i], best.score[i])] for i, q in enumerate(ids[::50])} == want
    assert best.scored < 0.2 * 120 * 6000


@pytest.mark.parametrize("parts", [16, 400])
def test_top_k_in_rounds(spark, monkeypatch, parts):
    """Many pivots and parts, blocks of few queries, many copies of one vector, and a dimension that the sample misses."""
    monkeypatch.setattr(covertree, "LEAST", 8)
    monkeypatch.setattr(covertree, "PARTS", parts)
    monkeypatch.setattr(covertree, "BLOCK", 7)
    monkeypatch.setattr(covertree, "SAMPLE", 60)
    r = np.random.default_rng(6)
    x = (np.eye(8)[r.integers(0, 8, 900)] + r.normal(size=(900, 8)) * 0.1).round(3)
    x[300:600] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + 50 * i, [0.5 * i, 1.0]) for i in range(3)]
    got = defaultdict(list)
    for q in covertree.top_k_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect():
        got[q.query_id].append((q["rank"], q.vec_id, q.score))
    want = brute_top(np.arange(900), np.floor(x * 256).astype(np.int64), np.arange(900) % 50 == 0, 5)
    want |= brute_top(np.array([2000, 2050, 2100]), np.array([[0, 256], [128, 256], [256, 256]]), np.ones(3, bool), 5)
    assert {k: sorted(v) for k, v in got.items()} == {k: [(i + 1, *p) for i, p in enumerate(v)] for k, v in want.items()}


def test_top_k_of_large_numbers(spark):
    kind = "vec_id long, embedding array<double>"
    fine = [(0, [1e6, 3.0]), (1, [1e6 - 1, 2.0]), (2, [-1e6, 1.0]), (50, [0.004, 1.0])]
    got = {(q.query_id, q["rank"]): (q.vec_id, q.score) for q in covertree.top_k_search(spark.createDataFrame(fine, kind), F.col("vec_id") % 50 == 0).collect()}
    assert got[0, 1] == (1, 256000000 * 255999744 + 768 * 512) and got[50, 1] == (0, 256000000 + 256 * 768)
    with pytest.raises(Exception, match="may not fit 64 bits"):
        covertree.top_k_search(spark.createDataFrame([*fine, (3, [1e300, 0.0])], kind), F.col("vec_id") % 50 == 0).collect()


def test_top_k_in_spark(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7) / 8, -0.3, 0.11 * (i % 3)], "extra") for i in range(120)]
    rows += [(500, None, "e"), (550, [0.1, None, 0.2], "e"), (600, [nan, 0.0, 0.0], "e"), (650, [inf, 0.0, 0.0], "e"), (700, [], "e"), (750, [0.5, 0.5], "e"), (None, [0.1, 0.1, 0.1], "e"), (50, rows[50][1], "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = defaultdict(list)
    for r in covertree.top_k_search(df, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    good = [(k, v) for k, v, _ in rows if k is not None and v and len(v) == 3 and None not in v and np.isfinite(v).all()]
    ids, x = np.array([k for k, _ in good]), np.floor(np.array([v for _, v in good], np.float32).astype(np.float64) * 256).astype(np.int64)
    want = brute_top(ids, x, ids % 50 == 0, 5)
    assert {k: sorted(v) for k, v in got.items()} == {k: [(i + 1, *p) for i, p in enumerate(v)] for k, v in want.items()}
    assert covertree.top_k_search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 400), st.integers(0, 5))
def test_bk_tree_against_brute_force(seed, n, radius):
    r = np.random.default_rng(seed)
    centres = r.integers(0, 1 << 63, max(1, n // 20), np.uint64)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, r.integers(0, 6), replace=False)) for _ in range(n)], np.uint64)
    x = r.permutation(np.unique(centres[r.integers(0, len(centres), n)] ^ flips)) if n else np.zeros(0, np.uint64)
    n = len(x)
    found = [(int(i), int(j)) for q, t in simhash.BkTree(x).within(x, radius) for i, j in zip(q, t, strict=True)]
    want = {(i, j) for i in range(n) for j in range(n) if int(x[i] ^ x[j]).bit_count() <= radius}
    assert len(found) == len(want) and set(found) == want


def test_bk_tree_has_no_depth_limit():
    """Fingerprints at one distance of each other make a chain; links come in blocks."""
    chain = np.array([(1 << i) - 1 for i in range(64)], np.uint64)
    assert sum(len(q) for q, _ in simhash.BkTree(chain).within(chain, 64)) == 64 * 64
    r = np.random.default_rng(2)
    near = np.unique(np.array([sum(1 << int(b) for b in r.choice(64, 3, replace=False)) for _ in range(9000)], np.uint64))
    found = simhash.Forest(len(near))
    for q, t in simhash.BkTree(near).within(near, 6):
        assert len(q) <= simhash.LEAF * len(near)
        found.link(q, t)
    assert (found.settle() == 0).all()


def test_links_within_frequent_blocks(spark, monkeypatch):
    """Blocks that many fingerprints share are cut by their other bits, and in the end into parts; no link is lost."""
    monkeypatch.setattr(simhash, "SHARD", 64)
    monkeypatch.setattr(simhash, "HOT", 100)
    r = np.random.default_rng(8)
    some = r.integers(0, 1 << 48, 700, np.uint64)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, r.integers(1, 5), replace=False)) for _ in range(700)], np.uint64)
    prints = np.unique(np.concatenate([some, some ^ flips, np.arange(300, dtype=np.uint64) << np.uint64(50)]))
    rows = [(i, int(p)) for i, p in enumerate(prints.view(np.int64))]
    links = simhash.fingerprint_links(spark.createDataFrame(rows, "node long, fp long").repartition(4), 3).collect()
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    want = reachable(len(prints), list(zip(*np.nonzero(near))))
    assert reachable(len(prints), [tuple(x) for x in links]) == want and len(set(want)) < len(prints) - 300


def test_rows_alike_are_searched_a_few_times(monkeypatch):
    """Ten thousand near copies of one key, each with a fingerprint of its own: work in proportion to rows, and all connected."""
    r = np.random.default_rng(9)
    n = 10_000
    prints = np.array([sum(1 << int(b) for b in r.choice(64, 4, replace=False)) for _ in range(n)], np.uint64)
    sketches = np.tile(r.integers(0, 256, 80, np.uint8), (n, 1))
    sketches[np.arange(n), r.integers(0, 80, n)] ^= 1
    alike = simhash._Alike(prints, sketches, 14, 57.6)
    links = []
    assert len(alike.gather(np.arange(n), lambda x, y, e: links.append((x, y)))) == 1
    assert sum(len(x) for x, _ in links) <= 2 * simhash.QUERIES * n
    two = np.arange(0, n, 2), np.arange(1, n, 2)
    seen = []
    alike.across(*(alike.gather(x, lambda *_: None) for x in two), lambda x, y, e: seen.append(len(x)))
    assert sum(seen) == 1


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 200), st.sampled_from([2, 5, 200]))
def test_groups_alike_against_brute_force(seed, n, kinds):
    r = np.random.default_rng(seed)
    base = r.integers(0, 4, (kinds, 80), np.uint8)
    of = r.integers(0, kinds, n)
    sketches = np.where(r.random((n, 80)) < 0.1, r.integers(0, 4, (n, 80), np.uint8), base[of])
    prints = r.integers(0, 1 << 63, kinds, np.uint64)[of] ^ np.where(r.random(n) < 0.5, 0, 1 << r.integers(0, 63, n)).astype(np.uint64)
    alike = simhash._Alike(prints, sketches, 3, 60.0)
    ok = lambda i, j: int(prints[i] ^ prints[j]).bit_count() <= 3 and (sketches[i] == sketches[j]).sum() >= 60
    links = []
    alike.gather(np.arange(n), lambda x, y, e: links.extend(zip(x.tolist(), y.tolist(), e.tolist())))
    assert all(ok(i, j) and e == (sketches[i] == sketches[j]).sum() for i, j, e in links)
    linked = {i for i, j, _ in links} | {j for i, j, _ in links}
    assert linked == {i for i in range(n) for j in range(n) if i != j and ok(i, j)}


def test_boilerplate_of_one_fingerprint(spark, none):
    """Thousands of texts that differ in one word: a link each, not each with each."""
    words = [f"word{i}" for i in range(400)]
    rows = [(i, " ".join([*words, f"id{i}"])) for i in range(4000)] + [(9000 + i, " ".join(words[:150]) + " same") for i in range(500)] + [(9999, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = dict(map(tuple, simhash.similar_documents(df).collect()))
    assert got == {i: 0 for i in range(4000)} | {9000 + i: 9000 for i in range(500)} | {9999: 9999}


def reachable(n, linked):
    label = list(range(n))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 60), st.lists(st.tuples(st.integers(0, 59), st.integers(0, 59)), max_size=80))
def test_forest(n, pairs):
    pairs = [(a % n, b % n) for a, b in pairs]
    a, b = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
    assert simhash.forest(n, a, b).tolist() == reachable(n, pairs)


def test_components_in_spark(spark):
    path = [(i, i + 1) for i in range(0, 90)]
    star = [(200, i) for i in range(201, 260)]
    edges = spark.createDataFrame([*path, *star, *star, (7, 7), (300, 300), (None, 4), (400, None)], "u long, v long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(91)} | {i: 200 for i in range(200, 260)}
    assert components.connected_components(edges.limit(0)).count() == 0


def brute_groups(rows, prints):
    ids = [k for k, _ in rows]
    n = len(rows)
    linked = [(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    label = reachable(n, linked)
    least = defaultdict(lambda: None)
    for k, c in zip(ids, label, strict=True):
        if k is not None:
            least[c] = k if least[c] is None else min(k, least[c])
    return [least[c] for c in label]


def test_near_duplicates(docs, rows, none, monkeypatch):
    prints = [simhash.simhash(t) for _, t in rows]
    want = Counter((k, f"{p:016x}", c) for (k, _), p, c in zip(rows, prints, brute_groups(rows, prints), strict=True))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    # hot shards are cut into parts, with the same result
    monkeypatch.setattr(simhash, "HOT", 40)
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(none).count() == 0


def test_fingerprint_by_hand():
    import xxhash

    words = ["the", "quick", "brown", "fox"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in (0, 1)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > 1)
    assert simhash.simhash("The QUICK\tbrown\n\x0b fox ") == want
    assert simhash.simhash("Été a") == xxhash.xxh64_intdigest("Été a".encode(), 42)
    assert simhash.simhash(None) == simhash.simhash(" \n") == 0


def shingles(text, words=5):
    found = text.encode().lower().split()
    return set(zip(*(found[i:] for i in range(words)))) or {tuple(found)}


def test_similar_documents(spark, none):
    own = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in own.select("doc_id", "text").collect()]
    sets = [shingles(t) for _, t in rows]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(own).collect()}
    best = defaultdict(float)
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common:
                share = common / (len(sets[i]) + len(sets[j]) - common)
                best[rows[i][0]], best[rows[j][0]] = max(best[rows[i][0]], share), max(best[rows[j][0]], share)
                if share >= 0.8 - 1e-9:
                    assert got[rows[i][0]] == got[rows[j][0]]
    moved = [k for k, c in got.items() if k != c]
    assert moved and min(best[k] for k in moved) >= 0.8 - 1e-9
    assert simhash.similar_documents(none).count() == 0


def similar_pairs(shares, seed):
    """Texts (id, text): for each (common, own) two that have so many shingles of five words in common, and so many each of their own."""
    r = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in r.integers(0, 1 << 40, n)]
    out = []
    for i, (common, own) in enumerate(shares):
        shared = word(common + 4)
        out += [(2 * i, " ".join(shared + word(own))), (2 * i + 1, " ".join(shared + word(own)))]
    return out


def brute_components(rows, least=0.8):
    """The smallest id reachable over pairs with a Jaccard similarity of ``least`` or more, of all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common >= least * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {k: rows[root(i)][0] for i, (k, _) in enumerate(rows)}


def test_similar_documents_find_every_pair_at_the_bound(spark, monkeypatch):
    rows = similar_pairs([(40, 5), (200, 25), (400, 50), (200, 20)] * 100, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_components(rows)
    assert sum(k != c for k, c in want.items()) == 400
    assert dict(map(tuple, simhash.similar_documents(df).collect())) == want
    # hot shards are cut into parts, and no shingle counts as common
    monkeypatch.setattr(simhash, "HOT", 40)
    monkeypatch.setattr(simhash, "MOST", 1)
    assert dict(map(tuple, simhash.similar_documents(df).collect())) == want


def test_similar_documents_link_nothing_below_the_bound(spark):
    rows = similar_pairs([(48, 8), (198, 33), (402, 67), (196, 42), (190, 25)] * 40, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert all(k == c for k, c in simhash.similar_documents(df).collect())
    # a chain: each text is alike to the next by 0.8 or more, and one hangs on by less
    words = [f"w{i}" for i in range(130)]
    chain = [(k, " ".join(words[5 * k : 5 * k + 94])) for k in range(4)] + [(9, " ".join(words[:64] + [f"x{i}" for i in range(30)]))]
    got = dict(map(tuple, simhash.similar_documents(spark.createDataFrame(chain, "doc_id long, text string")).collect()))
    assert got == brute_components(chain) == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 300), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10**6))
def test_exact_filter_keeps_similar_sets(common, own, other, seed):
    r = np.random.default_rng(seed)
    hashes = r.integers(0, 1 << 63, common + own + other, np.uint64)
    x, y = np.sort(hashes[: common + own]), np.sort(np.concatenate([hashes[:common], hashes[common + own :]]))
    if common < 0.8 * (common + own + other) - 1e-9:
        return
    a, b = x[: simhash.prefix_length(len(x), 0.8)], y[: simhash.prefix_length(len(y), 0.8)]
    assert np.intersect1d(a, b).size
    apart = np.abs(np.frombuffer(simhash.bins(x), np.uint8).astype(int) - np.frombuffer(simhash.bins(y), np.uint8)).sum()
    assert apart <= own + other


def brute_repeats(rows, length):
    """rows: distinct (key, text). What goes from each, by all windows of the corpus."""
    raws = [t.encode() for _, t in rows]
    counts = Counter(raw[s : s + length] for raw in raws for s in range(len(raw) - length + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if counts[raw[s : s + length]] > 1:
                gone[s : s + length] = True
        out.append((len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=40, max_size=120), min_size=1, max_size=6), st.integers(0, 10**6), st.sampled_from([2, 4, 256]))
def test_window_classes(pieces, seed, letters):
    r = np.random.default_rng(seed)
    pieces = [bytes(b % letters for b in p) for p in pieces]
    pieces += [pieces[r.integers(len(pieces))][3:] + b"tail" for _ in range(3)]
    pieces = [p for p in dict.fromkeys(pieces) if len(p) >= 40]
    counts = [len(p) - 39 for p in pieces]
    group, offset = suffix_dedup.window_classes(pieces, counts, 40)
    windows = [p[i : i + 40] for p, n in zip(pieces, counts) for i in range(n)]
    by_window, by_group = defaultdict(set), defaultdict(set)
    for w, g in zip(windows, group.tolist(), strict=True):
        by_window[w].add(g)
        by_group[g].add(w)
    assert all(len(x) == 1 for x in by_window.values()) and all(len(x) == 1 for x in by_group.values())
    assert offset[-1] == len(windows)


@pytest.mark.parametrize("split", [512, 3])
def test_repeats(spark, docs, none, monkeypatch, split):
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    r = np.random.default_rng(5)
    own = [(k, t) for k, t in {(x.doc_id, x.text or "") for x in docs.select("doc_id", "text").collect()}]
    shared = "".join(r.choice(list("abcdefgh "), 900))
    for i in range(20):  # one passage in many contexts, some cut short, and low-entropy text
        own.append((20000 + i, "".join(r.choice(list("abcdefgh "), 300)) + shared[: 900 - 20 * i] + "".join(r.choice(list("xyz "), 200))))
    own += [(30000, "ab" * 700), (30001, "c" * 405), (30002, "c" * 400 + "d"), (30003, "é" * 250), (30004, "é" * 250 + "x"), (30005, shared[100:499]), (30006, shared[100:500])]
    df = spark.createDataFrame(own, "doc_id long, text string")
    got = Counter(tuple(x) for x in suffix_dedup.repeat_digests(df).collect())
    assert got == Counter((k, *x, x[0] - x[1]) for (k, _), x in zip(own, brute_repeats(own, 400), strict=True))
    assert suffix_dedup.repeat_digests(none).count() == 0


@given(st.lists(st.integers(1, (1 << 64) - 1), min_size=1, max_size=50))
def test_leading_zero_bytes(words):
    words += [(1 << s) - d for s in range(1, 64) for d in (0, 1)]
    assert suffix_dedup.leading_zero_bytes(np.array(words, np.uint64)).tolist() == [8 - (w.bit_length() + 7) // 8 for w in words]


@pytest.mark.parametrize("extra", [1, 7, 9, 16])
def test_repeats_before_bytes_far_apart(spark, extra):
    """The words after the repeated part differ by nearly a power of two: a rounded logarithm would lose a byte."""
    r = np.random.default_rng(extra)
    rows = []
    for i in range(6):
        shared = "".join(r.choice(list("abcdefgh "), 400 + extra))
        head = ["".join(r.choice(list("uvwxyz"), 50 + 3 * i + j)) for j in range(2)]
        rows += [(2 * i, head[0] + shared + "<@" * 60), (2 * i + 1, head[1] + shared + "\xff" * 60)]
    pieces = [(shared.encode() + (x * 60).encode()) for x in ("<@", "\xff")]
    counts = [len(p) - 399 for p in pieces]
    group, offset = suffix_dedup.window_classes(pieces, counts, 400)
    assert (group[: extra + 1] == group[offset[1] : offset[1] + extra + 1]).all()
    got = Counter(tuple(x) for x in suffix_dedup.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter((k, *x, x[0] - x[1]) for (k, _), x in zip(rows, brute_repeats(rows, 400), strict=True))


def test_repeated_rows_are_one_document(spark):
    text = "".join(np.random.default_rng(1).choice(list("abcdefgh "), 1000))
    df = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (2, text[:600], "c")], "doc_id long, text string, n_bytes string")
    got = suffix_dedup.drop_repeats(df).collect()
    assert sorted((r.doc_id, r.n_bytes, len(r.kept)) for r in got) == [(1, 1000, 400), (1, 1000, 400), (2, 600, 0)]


def brute_lines(rows):
    first = {}
    for k, t in sorted({x for x in rows if x[0] is not None}):
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            first.setdefault(tuple(lines[p : p + 3]), (k, p, t))
    out = []
    for k, t in rows:
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - 2) if k is not None else ():
            if first[tuple(lines[p : p + 3])] != (k, p, t):
                gone |= {p, p + 1, p + 2}
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((k, len(lines), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_lines(docs, rows, none):
    assert Counter(tuple(r) for r in line_dedup.line_digests(docs).collect()) == Counter(brute_lines(rows))
    done = line_dedup.dedup_lines(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    assert done.where("doc_id = 9001 and text is null").count() == 1
    assert line_dedup.line_digests(none).count() == 0


def test_no_python_in_native_plans(docs):
    from strataform.llm import secret_scan

    for df in (line_dedup.line_digests(docs), secret_scan.secret_digests(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_reserved_names_are_refused(docs):
    from strataform.llm import packing, secret_scan

    odd = docs.withColumn("__x", F.lit(1))
    for apply in (line_dedup.dedup_lines, suffix_dedup.drop_repeats, secret_scan.scan_secrets, lambda df: packing.best_fit_pack(df, 8, ["doc_id"])):
        with pytest.raises(ValueError, match="__x"):
            apply(odd)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from strataform.llm.common import shared_dir

    def session(master, folder=None):
        conf = SimpleNamespace(get=lambda name, default=None: default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda name: folder)))

    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
        assert shared_dir(session(master, "hdfs://shared/")) == "hdfs://shared"
    assert shared_dir(session("local[4]")) == shared_dir(session("local")) != ""


def test_pipeline_stages_against_brute_force(spark, docs):
    import corpus_pipeline as C
    from test_text_operators import brute_secrets, plain_score

    now = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null and text is not null").cache()
    stages = dict(C.STAGES)
    scored = stages["quality classifier"](spark, now, "/root/testdata/sf0.001").cache()
    assert scored.columns == now.columns and 0.5 * now.count() < scored.count() < now.count()
    model = quality.fit_quality(now, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), F.coalesce(fold("doc_id", 3) != 1, F.lit(False)))
    want = Counter(tuple(r) for r in now.select("doc_id", "text").collect() if plain_score(model, r.text) >= 0.5)
    assert Counter(tuple(r) for r in scored.select("doc_id", "text").collect()) == want
    lines = stages["line dedup"](spark, scored, "").cache()
    rows = [(r.doc_id, r.text) for r in scored.select("doc_id", "text").collect()]
    want = Counter()
    for (k, t), (_, _, removed, _, digest) in zip(rows, brute_lines(rows), strict=True):
        if not removed or any(hashlib.sha256(x.encode()).hexdigest() == digest and x.strip() for x in [kept(rows, k, t)]):
            want[k, digest] += 1
    assert Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in lines.collect()) == want
    alone = stages["SimHash near-dedup"](spark, lines, "").cache()
    before = [(r.doc_id, r.text) for r in lines.select("doc_id", "text").distinct().collect()]
    root = brute_components(sorted(before))
    assert Counter(r.doc_id for r in alone.collect()) == Counter(r.doc_id for r in lines.collect() if root[r.doc_id] == r.doc_id)
    assert 0 < alone.count() < lines.count()
    clean = stages["secret scans"](spark, alone, "").cache()
    assert clean.columns == now.columns and clean.count() == alone.count()
    before = {r.doc_id: r.text for r in alone.collect()}
    for r in clean.collect():
        spans = brute_secrets(before[r.doc_id])
        assert (r.text == before[r.doc_id]) == (not spans) and r.n_chars == len(r.text)
    packed = stages["best-fit packing"](spark, clean, "")
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}


def kept(rows, key, text):
    lines = text.split("\n")
    first = {}
    for k, t in sorted(set(rows)):
        own = t.split("\n")
        for p in range(len(own) - 2):
            first.setdefault(tuple(own[p : p + 3]), (k, p, t))
    gone = {p + o for p in range(len(lines) - 2) if first[tuple(lines[p : p + 3])] != (key, p, text) for o in range(3)}
    return "\n".join(x for i, x in enumerate(lines) if i not in gone)


def test_recall_of_the_near_duplicate_stage_by_similarity(spark):
    """Of made-up pairs of each similarity, all from 0.8 on lose one document, and none below does."""
    import corpus_pipeline as C

    bands = {0.75: (150, 25), 0.8: (160, 20), 0.85: (170, 15), 0.9: (180, 10), 0.97: (194, 3)}
    rows = [(10_000 * b + k, text) for b, band in enumerate(bands.values()) for k, text in similar_pairs([band] * 100, b)]
    docs_ = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    left = {r.doc_id for r in C.near_copies(spark, docs_, "").collect()}
    gone = {s: sum(10_000 * b + 2 * i + 1 not in left for i in range(100)) for b, s in enumerate(bands)}
    assert gone == {0.75: 0, 0.8: 100, 0.85: 100, 0.9: 100, 0.97: 100}
    assert all(10_000 * b + 2 * i in left for b in range(len(bands)) for i in range(100))


def test_pipeline_runs(spark):
    import corpus_pipeline as C

    got = C.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 100 and "sequence_id" in got.columns


def test_fine_bins_lose_no_pair_and_tell_long_texts_apart():
    r = np.random.default_rng(3)
    for n in (1, 50, 900, 2100, 4095, 4096, 30_000):
        one, other = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)), np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        for share in (0.8, 0.9, 0.95, 1.0):
            two = np.unique(np.concatenate([one[: int(len(one) * share)], other[: int(len(one) * (1 - share) / 3)]]))
            assert simhash.apart(simhash.fine_bins(one), simhash.fine_bins(two)) <= len(np.setxor1d(one, two))
        if n >= 900:
            assert simhash.apart(simhash.fine_bins(one), simhash.fine_bins(other)) * 1.8 > 0.2 * 2 * n


def test_long_texts_with_a_passage_in_common_are_not_sent(spark, monkeypatch):
    r = np.random.default_rng(4)
    said = [" ".join(f"w{x}" for x in r.integers(0, 1 << 40, 20_000)) for _ in range(12)]
    passage = [" ".join(f"p{x}" for x in r.integers(0, 1 << 40, 2_000)) for _ in range(12)]
    texts = [f"{passage[i]} {said[i]} {passage[(i + 1) % 12]}" for i in range(12)]
    texts.append(texts[3] + " and an end")
    asked = []
    plain = simhash.confirmed
    monkeypatch.setattr(simhash, "confirmed", lambda pairs, *a: (asked.append({(r.u, r.v) for r in pairs.distinct().collect()}), plain(pairs, *a))[1])
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {**{i: i for i in range(12)}, 12: 3}
    assert not asked[1]


def test_tables_that_nothing_reads_any_more_go(spark):
    from strataform.llm import common

    first, second = (common.written(spark.range(3), name) for name in ("first", "second"))
    common.discard(first)
    assert second.count() == 3 and not any("/first-" in p for p in common._WRITTEN)
    with pytest.raises(Exception):
        first.count()
