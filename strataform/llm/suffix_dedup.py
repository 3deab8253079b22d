"""Removal of long byte strings that occur more than once, by sharded suffix arrays.

1. Anchors. A 32-byte gram whose hash has six leading zero bits is an anchor; a window of ``length`` bytes without one has the
   leftmost least gram of the window instead. Either way a window's anchors depend on its bytes alone, so a
   window with an anchor that occurs once in the corpus occurs once itself. All anchors are counted.
2. Segments. Every other window belongs to one of its anchors: the least by hash of those that aren't too frequent for one shard. Neighbouring windows of one anchor are shipped as one segment, keyed by the
   anchor's hash: equal windows have equal keys, so they meet. A task ships equal segments once, with all their places. An anchor with over ``SPLIT`` occurrences is dealt to several shards.
3. Suffix arrays. A shard's distinct segments are joined and sorted by Larsson and Sadakane's refinement in numpy: ranks by eight
   bytes, then doubled, with only unsorted groups sorted again. Common prefixes follow Kasai's rule that they shrink by at
   most one from a position to the next, in its form for arrays: prefixes are compared only where the byte before
   differs (the irreducible positions), and a running maximum gives the rest.
4. Merging. Windows of an anchor dealt to several shards are also looked up in the other shards' sorted window
   digests, by binary search, again in parts, so no task holds a whole group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import no_reserved, written

GRAM, BITS, SPLIT, SHARD_BYTES, ARRAY_BYTES, PIECE_BYTES = 32, 6, 512, 2_000_000, 200_000, 16_000_000
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def words_at(raw: bytes, pad: int = 0) -> np.ndarray:
    """The eight bytes from each position of ``raw`` as one big-endian number (``pad`` zero bytes are added at the end)."""
    raw = raw + bytes(pad)
    n = len(raw) - 7
    out = np.empty(max(n, 0), np.uint64)
    for o in range(min(8, max(n, 0))):
        out[o::8] = np.frombuffer(raw, ">u8", (len(raw) - o) // 8, o)
    return out


def gram_hashes(raw: bytes) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each position."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    w = words_at(raw)
    w *= _A
    w ^= w >> np.uint64(29)
    h = w[:n] * _B
    h += w[8 : 8 + n] * _C
    h ^= h >> np.uint64(31)
    h += w[16 : 16 + n] * _D
    h *= _A
    h += w[24 : 24 + n] * _B
    h ^= h >> np.uint64(32)
    h *= _C
    return h ^ (h >> np.uint64(29))


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all grams, anchor positions, windows without an anchor, the position each of these has instead)."""
    h = gram_hashes(raw)
    spots = np.flatnonzero(h >> np.uint64(64 - BITS) == 0)
    reach, windows = length - GRAM + 1, len(raw) - length + 1  # grams in a window; number of windows
    bounds = np.concatenate([[-1], spots, [len(h)]])
    bare, instead = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(np.diff(bounds) > reach):
        lo, hi = int(bounds[i]) + 1, min(int(bounds[i + 1]) - reach, windows - 1)
        for a in range(lo, hi + 1, 4096):
            b = min(a + 4096, hi + 1)
            view = np.lib.stride_tricks.sliding_window_view(h[a : b + reach - 1], reach)
            bare.append(np.arange(a, b))
            instead.append(np.arange(a, b) + view.argmin(axis=1))
    return h, spots, np.concatenate(bare), np.concatenate(instead)


def anchor_rows(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of all anchors of a text."""
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, spots, _, instead = anchors(raw, length)
    at = np.concatenate([spots, np.unique(instead)]) if len(instead) else spots
    return at, h[at]


def segments(raw: bytes, length: int, at: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(anchor hash, its count, first window, windows) of the runs of windows whose anchors all occur more than once.

    ``at`` and ``counts`` are the positions of this text's repeated anchors and how often they occur.
    """
    h, spots, bare, instead = anchors(raw, length)
    windows, reach = len(raw) - length + 1, length - GRAM + 1
    often = np.zeros(len(h), np.int64)
    often[at] = counts
    owner = np.full(windows, -1, np.int64)
    n = often[spots]
    known = spots[n > 0]
    # painted last, so it stays: of anchors not too frequent for one shard (then of each doubling) the least hash, then the leftmost
    grade = np.ceil(np.log2(np.maximum(often[known] / SPLIT, 1.0)))
    for p in known[np.lexsort((-known, ~h[known], -grade))]:
        owner[max(0, p - reach + 1) : p + 1] = p
    # a unique anchor rules out all its windows
    for p in spots[n == 0]:
        owner[max(0, p - reach + 1) : p + 1] = -1
    owner[bare] = np.where(often[instead] > 0, instead, -1)
    cuts = np.flatnonzero(np.diff(owner)) + 1
    starts = np.concatenate([[0], cuts])
    sizes = np.diff(np.concatenate([starts, [windows]]))
    signed = h.view(np.int64)
    return [(int(signed[p]), int(often[p]), int(s), int(k)) for p, s, k in zip(owner[starts], starts, sizes, strict=True) if p >= 0]


def suffix_order(raw: bytes, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first ``depth`` or more bytes, rank of each; suffixes equal so far share a rank)."""
    n = len(raw)
    key = words_at(raw, 7)
    order = np.argsort(key)
    sorted_key = key[order]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    done = 8
    tail = np.concatenate([~head[1:], [False]]) if n else head
    live = np.flatnonzero(~head | tail)  # places in the order that share their rank
    while done < depth and len(live):
        own = order[live]
        ahead = own + done
        ranks = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        both = (first[live] << 32) | ranks
        turn = np.argsort(both)
        own, both = own[turn], both[turn]
        order[live] = own
        new = np.concatenate([[True], both[1:] != both[:-1]])
        first[live] = np.maximum.accumulate(np.where(new, live, 0))
        rank[own] = first[live]
        same = ~new
        keep = same | np.concatenate([same[1:], [False]])
        live = live[keep]
        done *= 2
    return order, rank


def leading_zero_bytes(words: np.ndarray) -> np.ndarray:
    """How many bytes at the top of each number (not zero) are zero; in integers, as a float can't tell 2**56 - 1 from 2**56."""
    lead = np.zeros(len(words), np.int64)
    for shift in range(8, 64, 8):
        lead += words >> np.uint64(shift) == 0
    return lead


def common_prefixes(raw: bytes, order: np.ndarray, rank: np.ndarray, depth: int) -> np.ndarray:
    """For each position a common prefix with some other suffix: with the one before it in ``order``, or longer; up to ``depth``."""
    n = len(raw)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    data = np.frombuffer(raw, np.uint8)
    shared = np.bincount(rank, minlength=n)[rank] > 1  # equal to at least ``depth``
    position = np.arange(n)
    reducible = (before > 0) & (position > 0)
    reducible[reducible] = data[position[reducible] - 1] == data[before[reducible] - 1]
    todo = np.flatnonzero(~reducible & (before >= 0) & ~shared)
    found = np.zeros(n, np.int64)
    found[shared] = depth
    word = words_at(raw, depth + 16)
    a, b, size = todo, before[todo], 0
    while len(a) and size < depth:
        diff = word[a + size] ^ word[b + size]
        equal = diff == 0
        ended = ~equal
        found[a[ended]] = size + leading_zero_bytes(diff[ended])
        found[a[equal]] = size + 8
        a, b = a[equal], b[equal]
        size += 8
    return np.maximum.accumulate(position + found) - position


def window_classes(pieces: list[bytes], counts: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each window of each piece, one after the other; offset of each piece's windows): equal windows, equal class."""
    raw = b"".join(pieces)
    depth = 1 << max(3, (length - 1).bit_length())
    order, rank = suffix_order(raw, depth)
    prefix = common_prefixes(raw, order, rank, depth)
    # neighbours in the order that share ``length`` bytes: the later one says so, or they share a rank
    joined = np.zeros(len(raw), bool)
    joined[1:] = rank[order[1:]] == rank[order[:-1]]
    check = np.flatnonzero(~joined & (prefix[order] >= length))
    check = check[check > 0]
    if len(check):  # a running maximum may stem from another suffix than the neighbour: compare
        word = words_at(raw, length + 16)
        ok = np.ones(len(check), bool)
        a, b = order[check], order[check - 1]
        for o in [*range(0, length - 8, 8), length - 8]:
            live = np.flatnonzero(ok)
            if not len(live):
                break
            ok[live] = word[a[live] + o] == word[b[live] + o]
        joined[check[ok]] = True
    group = np.empty(len(raw), np.int64)
    group[order] = np.cumsum(~joined)
    sizes = np.array([len(p) for p in pieces])
    at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    n = np.array(counts)
    starts = np.repeat(at - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
    return group[starts], np.concatenate([[0], np.cumsum(n)])


def runs(starts: np.ndarray, length: int) -> np.ndarray:
    """Windows (sorted starts) as maximal covered runs: rows of (start, end)."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(starts) > length)
    return np.stack([starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + length], axis=1)


def merged(spans: np.ndarray) -> np.ndarray:
    """Rows of (start, end) in any order as sorted maximal runs; runs that touch are one."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > end[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])
    return np.stack([spans[new, 0], end[last]], axis=1)


#: A distinct segment of a task, and its places: documents, and for each place which of them and where.
_PIECES = pa.schema([("hash", pa.int64()), ("n", pa.int64()), ("windows", pa.int64()), ("data", pa.binary()), ("docs", pa.list_(pa.string())), ("doc_of", pa.binary()), ("starts", pa.binary())])
_PIECES_SQL = "hash long, n long, windows long, data binary, docs array<string>, doc_of binary, starts binary"
_FOUND = pa.schema([("doc", pa.string()), ("spans", pa.binary()), ("hash", pa.int64()), ("part", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("docs", pa.list_(pa.string())), ("starts", pa.binary())])
_FOUND_SQL = "doc string, spans binary, hash long, part int, high binary, low binary, docs array<string>, starts binary"


def _by_hash(hashes: list[int], pieces: list[bytes]) -> Iterator[list[int]]:
    """Indices of ``pieces`` in runs of about ``ARRAY_BYTES``; pieces of one hash stay together."""
    own: list[int] = []
    size, last = 0, None
    for k in sorted(range(len(pieces)), key=hashes.__getitem__):
        if size > ARRAY_BYTES and hashes[k] != last:
            yield own
            own, size = [], 0
        own.append(k)
        size += len(pieces[k])
        last = hashes[k]
    if own:
        yield own


def _solve(length: int):
    def run(table: pa.Table) -> pa.Table:
        t = {name: table.column(name).to_pylist() for name in ("hash", "n", "windows", "data", "docs", "doc_of", "starts")}
        place: dict[bytes, int] = {}
        where = [place.setdefault(d, len(place)) for d in t["data"]]
        pieces = list(place)
        doc_of, starts = ([np.frombuffer(x, kind) for x in t[name]] for name, kind in (("doc_of", "<i4"), ("starts", "<i8")))
        times = np.bincount(where, [len(x) for x in starts], len(pieces)).astype(np.int64)
        first: dict[int, int] = {}
        for i, k in enumerate(where):
            first.setdefault(k, i)
        counts = [t["windows"][first[k]] for k in range(len(pieces))]
        offset = np.concatenate([[0], np.cumsum(counts)])
        group = np.empty(offset[-1], np.int64)
        classes = 0
        # equal windows have one anchor hash, so arrays of a few whole hashes at a time are enough, and stay in the processor's cache
        for own in _by_hash([t["hash"][first[k]] for k in range(len(pieces))], pieces):
            found, at = window_classes([pieces[k] for k in own], [counts[k] for k in own], length)
            names, found = np.unique(found, return_inverse=True)
            for i, k in enumerate(own):
                group[offset[k] : offset[k + 1]] = found[at[i] : at[i + 1]] + classes
            classes += len(names)
        total = np.bincount(group, np.repeat(times, counts))
        again = total[group] > 1
        out: dict[str, list] = {name: [] for name in _FOUND.names}

        def emit(**row):
            for name in out:
                out[name].append(row.get(name))

        found = [runs(np.flatnonzero(again[offset[k] : offset[k + 1]]), length) for k in range(len(pieces))]
        of_doc: dict[str, list[np.ndarray]] = {}
        for i, k in enumerate(where):
            if len(found[k]):
                moved = starts[i][:, None, None] + found[k][None]
                for j, doc in enumerate(t["docs"][i]):
                    own = moved if len(t["docs"][i]) == 1 else moved[doc_of[i] == j]
                    of_doc.setdefault(doc, []).append(own.reshape(-1, 2))
        for doc, spans in of_doc.items():
            emit(doc=doc, spans=merged(np.concatenate(spans)).astype("<i8").tobytes())
        # windows of anchors that other shards hold too: one digest for each class, with its place if it is alone here
        by_hash: dict[int, list[int]] = {}
        for k, i in first.items():
            if t["n"][i] > SPLIT:
                by_hash.setdefault(t["hash"][i], []).append(k)
        for hash_, own in by_hash.items():
            parts = -(-t["n"][first[own[0]]] // SPLIT)
            seen: set[int] = set()
            rows: list[tuple[int, int, str | None, int]] = []
            for k in own:
                for j in range(counts[k]):
                    g = int(group[offset[k] + j])
                    if g in seen:
                        continue
                    seen.add(g)
                    digest = hashlib.blake2b(pieces[k][j : j + length], digest_size=16).digest()
                    alone = total[g] == 1
                    rows.append((int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little"), t["docs"][first[k]][0] if alone else None, int(starts[first[k]][0]) + j))
            rows.sort(key=lambda r: r[:2])
            high, low = (np.array([r[c] for r in rows], np.uint64) for c in (0, 1))
            part = (low % np.uint64(parts)).astype(np.int64)
            for p in np.unique(part):
                mine = np.flatnonzero(part == p)
                emit(hash=hash_, part=int(p), high=high[mine].tobytes(), low=low[mine].tobytes(), docs=[rows[m][2] for m in mine], starts=np.array([rows[m][3] for m in mine], "<i8").tobytes())
        return pa.table({f.name: pa.array(out[f.name], f.type) for f in _FOUND}, schema=_FOUND)

    return run


def _merge(length: int):
    def run(table: pa.Table) -> pa.Table:
        high, low = ([np.frombuffer(x, np.uint64) for x in table.column(c).to_pylist()] for c in ("high", "low"))
        every_high, every_low = np.concatenate(high), np.concatenate(low)
        order = np.lexsort((every_low, every_high))
        every_high, every_low = every_high[order], every_low[order]
        docs, spans = [], []
        for h, w, names, starts in zip(high, low, table.column("docs").to_pylist(), table.column("starts").to_pylist(), strict=True):
            lo, hi = np.searchsorted(every_high, h, "left"), np.searchsorted(every_high, h, "right")
            starts = np.frombuffer(starts, "<i8")
            for i in np.flatnonzero(hi - lo > 1):
                if names[i] is not None and (every_low[lo[i] : hi[i]] == w[i]).sum() > 1:
                    docs.append(names[i])
                    spans.append(np.array([starts[i], starts[i] + length], "<i8").tobytes())
        return pa.table({"doc": pa.array(docs, pa.string()), "spans": pa.array(spans, pa.binary())})

    return run


def _doc_key(key: str, text: str) -> Column:
    return F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("-")), F.hex(F.xxhash64(text)), F.length(text).cast("string"))


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """``doc`` (as ``_doc_key`` gives it) and ``spans``: a list of packed (start, end) bytes covered by repeated strings of ``length`` bytes.

    Rows equal in key and text are one document. Strings are judged on the input; matches never cross documents.
    """
    import zstandard

    rows = df.where(F.octet_length(text) >= length).select(_doc_key(key, text).alias("doc"), text)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, at, hashes = [], [], []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p, h = anchor_rows(t.encode("utf-8"), length)
                at.append(p)
                hashes.append(h.view(np.int64))
                names += [doc] * len(p)
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(at), pa.int64()), pa.array(np.concatenate(hashes), pa.int64())], names=["doc", "at", "hash"])

    found = written(rows.mapInArrow(find, "doc string, at long, hash long"), "anchors")
    often = found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("hash").bitwiseXOR(F.lit(0).cast("long")).alias("same"), "n")
    marks = found.join(often, found["hash"] == often["same"]).groupBy("doc").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [pack.compress(t.encode("utf-8")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc", "packed"])

    texts = rows.mapInArrow(squeeze, "doc string, packed binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held: dict[tuple[int, bytes], tuple[int, int, dict[str, list[int]]]] = {}

        def flush() -> pa.RecordBatch:
            docs = [list(at) for _, _, at in held.values()]
            doc_of = [np.repeat(np.arange(len(at), dtype="<i4"), [len(x) for x in at.values()]).tobytes() for _, _, at in held.values()]
            starts = [np.array([s for x in at.values() for s in x], "<i8").tobytes() for _, _, at in held.values()]
            columns = [[h for h, _ in held], [n for n, _, _ in held.values()], [w for _, w, _ in held.values()], [d for _, d in held], docs, doc_of, starts]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

        size = 0
        for batch in batches:
            for doc, packed, at, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = unpack.decompress(packed)
                for h, count, start, windows in segments(raw, length, np.array(at), np.array(n)):
                    data = raw[start : start + windows + length - 1]
                    got = held.get((h, data))
                    if got is None:
                        got = held[h, data] = (count, windows, {})
                        size += len(data)
                    got[2].setdefault(doc, []).append(start)
                    size += 40
                if size > PIECE_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    joined = texts.join(marks, "doc").dropDuplicates(["doc"]).select("doc", "packed", "at", "n")
    pieces = written(joined.mapInArrow(cut, _PIECES_SQL), "segments")
    size = pieces.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    share = F.pmod(F.xxhash64("docs", "starts"), F.ceil(F.col("n") / SPLIT))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("hash", share), F.lit(shards)))
    solved = written(dealt.groupBy("shard").applyInArrow(_solve(length), _FOUND_SQL), "solved")
    merged = solved.where("hash is not null").groupBy("hash", "part").applyInArrow(_merge(length), "doc string, spans binary")
    spans = solved.where("doc is not null").select("doc", "spans").unionByName(merged)
    return spans.groupBy("doc").agg(F.collect_list("spans").alias("spans"))


def merged_spans(packed: list[bytes] | None) -> list[tuple[int, int]]:
    """Packed spans as sorted maximal runs."""
    return [(int(a), int(b)) for a, b in merged(np.frombuffer(b"".join(packed or []), "<i8").reshape(-1, 2))]


def drop_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """Add n_bytes, spans (array of start, end in bytes) and kept (binary: the text without them) to ``df``.

    Every byte covered by a string of ``length`` bytes that also starts elsewhere, in the same or another document, goes;
    copies go all alike, so none is left of text that occurs twice. Null texts count as empty. Rows equal in key
    and text are one document: they aren't elsewhere for each other. Existing columns with the names of the results are replaced, and names that
    begin with ``__`` raise an error.
    """
    names = [c for c in no_reserved(df).columns if c not in ("n_bytes", "spans", "kept")]
    whole = df.select(*names).withColumn(text, F.coalesce(F.col(text), F.lit("")))
    spans = repeated_spans(whole, key, text, length).select(F.col("doc").alias("__doc"), F.col("spans").alias("__spans"))
    joined = whole.withColumn("__own", _doc_key(key, text)).join(spans, F.col("__own") == F.col("__doc"), "left").select(*names, "__spans")

    def run(batches):
        for batch in batches:
            size, runs_, kept = [], [], []
            for t, packed in zip(batch.column(names.index(text)).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                raw = t.encode("utf-8")
                own = merged_spans(packed)
                edges = [0, *(x for span in own for x in span), len(raw)]
                size.append(len(raw))
                runs_.append([{"start": a, "end": b} for a, b in own])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            item = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            own = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(size, pa.int64()), pa.array(runs_, pa.list_(item)), pa.array(kept, pa.binary())], names=[*names, "n_bytes", "spans", "kept"])

    schema = whole.withColumn("n_bytes", F.lit(0).cast("long")).withColumn("spans", F.expr("cast(null as array<struct<start:long,end:long>>)")).withColumn("kept", F.lit(b"")).schema
    return joined.mapInArrow(run, schema)


def repeat_digests(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """Per row: ``key``, n_bytes (of the whole text), n_removed, n_spans, kept_sha256 and kept_bytes (of what is left)."""
    done = drop_repeats(df.select(F.col(key).cast("long").alias(key), text), key, text, length)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return done.select(key, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("kept_bytes"))
