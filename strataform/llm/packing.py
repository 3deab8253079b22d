"""Best-fit packing of token sequences by exact-complement hashing.

The solver sees only how many pieces there are of each length (``capacity`` numbers at most, whatever the
corpus). Single lengths, sums of two and sums of three are indexed by their total. Lengths are taken from the longest down. For the gap that a piece
leaves, the index gives one, two or three available lengths with exactly that sum; such a combination is used as often as the counts allow. What finds no
exact complement is packed by best fit, longest first. Pieces as long as a sequence need no place in the plan. The plan says, for each other length, which ranks go to which
sequences; pieces get their rank within (length, salt) by a window, with as many salts as the length has groups of ``GROUP`` pieces or more.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, no_reserved, written

#: Pieces of one length that are ranked together: GROUP at least, and so many that there are about GROUPS groups at most.
GROUP, GROUPS = 500, 65_536


class Complements:
    """Available counts by length, and an index of the sums of one, two and three lengths.

    Counts only fall, so an entry of the index that has run out is passed for good: each is looked at once, whatever the number of lookups.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.left[0] = 0
        lengths, top = np.flatnonzero(self.left), len(counts) - 1
        longer, shorter = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
        fits = (longer >= shorter) & (longer + shorter <= top)
        longer, shorter = longer[fits], shorter[fits]
        order = np.lexsort((-longer, longer + shorter))  # of one sum, the longest first
        #: Pairs by their sum: those of sum s are longer[first[s]:first[s + 1]] and the shorter beside them; ``pair_at`` is the first that may be left.
        self.longer, self.shorter = longer[order], shorter[order]
        self.first = np.searchsorted(self.longer + self.shorter, np.arange(top + 2))
        self.pair_at = self.first[:-1].copy()
        #: Triples by their sum: a longest length, then a pair with the rest; ``triple_at`` is the longest that may be left.
        self.triple_at = np.arange(top + 1)

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """Lengths, at most three and longest first, that fill ``gap`` exactly and are available together."""
        if gap > 0 and self.left[gap] > 0:
            return (gap,)
        return self._pair(gap) or self._triple(gap)

    def _pair(self, total: int, taken: int = 0, longest: int | None = None) -> tuple[int, int] | None:
        """A pair with that sum, none over ``longest``, if one piece of length ``taken`` is spoken for."""
        have, at, stop = self.left, int(self.pair_at[total]), int(self.first[total + 1])
        settled = True
        while at < stop:
            x, y = int(self.longer[at]), int(self.shorter[at])
            gone = have[x] <= (x == y) or have[y] <= 0
            if not gone and (longest is None or x <= longest) and have[x] - (x == taken) > (x == y) and have[y] - (y == taken) > 0:
                return x, y
            settled = settled and gone
            at += 1
            if settled:
                self.pair_at[total] = at
        return None

    def _triple(self, total: int) -> tuple[int, int, int] | None:
        x = int(self.triple_at[total])
        while 3 * x >= total and x > 0:
            if self.left[x] > 0 and x < total:
                rest = self._pair(total - x, x, x)
                if rest:
                    return (x, *rest)
            x -= 1
            self.triple_at[total] = x  # a longest length without a pair for the rest never has one again
        return None

    def take(self, lengths: tuple[int, ...], most: int) -> int:
        """Use ``lengths`` together as often as the counts allow, ``most`` times at most."""
        need = {x: lengths.count(x) for x in lengths}
        times = min(most, *(int(self.left[x]) // n for x, n in need.items()))
        for x, n in need.items():
            self.left[x] -= n * times
        return times


def solve(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) of the sequences; ``counts[n]`` is the number of pieces of length n (0 < n <= capacity)."""
    plan: list[tuple[int, tuple[int, ...]]] = []
    if counts[capacity]:
        plan.append((int(counts[capacity]), (capacity,)))
    partial = counts.copy()
    partial[capacity] = 0
    index = Complements(partial)
    rest = np.zeros(capacity + 1, np.int64)
    for n in range(capacity - 1, 0, -1):
        while index.left[n] > 0:
            index.left[n] -= 1  # so that a complement doesn't use the piece itself
            found = index.exact(capacity - n)
            index.left[n] += 1
            if not found:
                rest[n] = index.left[n]
                index.left[n] = 0
                break
            plan.append((index.take((n, *found), 1 << 62), (n, *found)))
    return plan + _best_fit(rest, capacity)


def _best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit by falling length, on counts: open sequences with equal contents are handled together."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for n in range(capacity, 0, -1):
        todo = int(counts[n])
        while todo:
            fits = [gap for gap, groups in room.items() if gap >= n and groups]
            if fits:
                gap = min(fits)
                times, lengths = room[gap].pop()
                used = min(times, todo)
                if used < times:
                    room[gap].append((times - used, lengths))
                room.setdefault(gap - n, []).append((used, (*lengths, n)))
                todo -= used
            else:
                each = min(capacity // n, todo)
                times = todo // each
                room.setdefault(capacity - n * each, []).append((times, (n,) * each))
                todo -= times * each
    return [group for groups in room.values() for group in groups]


def placement(plan: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 42 | first rank), the sequence of that rank, and the offset, of each slot of the plan."""
    used: dict[int, int] = {}
    keys, first, offsets = [], [], []
    sequence = 0
    for times, lengths in plan:
        offset = 0
        for n in lengths:
            rank = used.get(n, 0)
            keys.append((n << 42) | rank)
            first.append(sequence)
            offsets.append(offset)
            used[n] = rank + times
            offset += n
        sequence += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return np.array(keys, np.int64)[order], np.array(first, np.int64)[order], np.array(offsets, np.int64)[order]


def best_fit_pack(pieces: DataFrame, capacity: int, order: list[str], length: str = "length") -> DataFrame:
    """Add sequence_id and offset (both long) to ``pieces``; sequences hold at most ``capacity``.

    ``order`` names columns that tell rows apart; rows equal in them are placed in any order among themselves. Existing
    columns with the names of the results are replaced; names that begin with ``__`` raise an error. Lengths outside 1..capacity, or null, raise an error: cut longer
    pieces first. An empty input gives an empty result. ``pieces`` is read several times, so it should be a written table. The driver
    gets a count for each length, and one for each group, of which there are ``GROUPS`` and one a length at most. Ids of full sequences are negative.
    """
    kept = no_reserved(pieces).drop("sequence_id", "offset")
    bad = f"{length} is null or {length} < 1 or {length} > {capacity}"
    sized = kept.withColumn("__n", F.expr(f"if({bad}, raise_error('length outside 1..{capacity}'), cast({length} as int))"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in sized.groupBy("__n").count().collect():
        counts[r["__n"]] = r["count"]
    partial = counts.copy()
    partial[capacity] = 0
    size = max(GROUP, -(-int(partial.sum()) // GROUPS))
    salts = np.maximum(-(-partial // size), 1)
    begin = np.cumsum(salts) - salts  # the place of a length's first salt among all
    own = F.element_at(F.array(*map(F.lit, salts.tolist())), F.col("__n") + 1)
    salted = sized.where(f"__n < {capacity}").withColumn("__salt", F.pmod(F.xxhash64(*order), own).cast("int"))
    groups = salted.groupBy("__n", "__salt").count().toPandas()
    table = np.zeros(int(salts.sum()), np.int64)
    table[begin[groups["__n"].to_numpy(np.int64)] + groups["__salt"].to_numpy(np.int64)] = groups["count"].to_numpy(np.int64)
    base = np.cumsum(table) - table
    base -= np.repeat(base[begin], salts)
    keys, first, offsets = placement(solve(partial, capacity))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("__n", "__salt").orderBy(*order)))
    names = kept.columns

    def run(batches):
        for batch in batches:
            n, salt, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("__n", "__salt", "__rank"))
            key = (n << 42) | (base[begin[n] + salt] + rank - 1)
            slot = np.searchsorted(keys, key, side="right") - 1
            own = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(first[slot] + key - keys[slot]), pa.array(offsets[slot])], names=[*names, "sequence_id", "offset"])

    # a full piece is a sequence, in no order: no exchange for these
    full = sized.where(f"__n = {capacity}").select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.mapInArrow(run, full.schema).unionByName(full)


#: Pieces so long that the merge loop of the faster library would be slow.
LONG_RUN = re.compile(r"\S{2000}|\s{500}")


@lru_cache(2)
def _tokenizer(path: str) -> tuple:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = {token.content for token in tokenizer.get_added_tokens_decoder().values()}
    # byte-level vocabularies write printable Latin-1 bytes as themselves and the rest, in order, from U+0100 on
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(map(letter.__getitem__, token)): n for token, n in tokenizer.get_vocab(with_added_tokens=False).items() if token not in added}
    fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = re.compile("|".join([LONG_RUN.pattern, *map(re.escape, sorted(added))]))
    return fast.encode_ordinary, lambda text: tokenizer.encode(text, add_special_tokens=False).ids, slow


def token_bytes(path: str, text: str | None) -> bytes:
    """The ids of ``text`` as little-endian 32-bit numbers (null: none): those of ``encode(text, add_special_tokens=False)`` of the tokenizers library.

    The vocabulary is that of the tokenizers file at ``path``. Its merges are run by tiktoken, which gives the same ids
    (held against the tokenizers library in the tests) at a third of the time; texts with very long runs, or with the name of an added token, go to tokenizers itself.
    """
    fast, own, slow = _tokenizer(path)
    ids = own(text) if slow.search(text or "") else fast(text or "")
    return np.array(ids, "<u4").tobytes()


def cut_pieces(docs: DataFrame, path: str, capacity: int, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize ``text``, append id ``end`` and cut into pieces of at most ``capacity`` ids: the first may be shorter.

    One row per piece: ``key`` (as long), piece int, start, length, ids_crc32 long. A null or empty text is one
    piece that holds just ``end``; a null key stays null; repeated rows give repeated pieces.
    """
    tail = np.array([end], "<u4").tobytes()

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in ("key", "piece", "start", "length", "ids_crc32")}
        for k, t in zip(batch[key], batch[text], strict=True):
            ids = token_bytes(path, t) + tail
            n = len(ids) // 4
            start, piece, stop = 0, 0, (n - 1) % capacity + 1
            while start < n:
                for name, value in zip(out, (k, piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])), strict=True):
                    out[name].append(value)
                start, stop, piece = stop, stop + capacity, piece + 1
        return out

    arrow = pa.schema([("key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    rows = docs.select(F.col(key).cast("long").alias(key), text)
    return map_arrow(rows, run, "key long, piece int, start long, length long, ids_crc32 long", arrow).withColumnRenamed("key", key)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``cut_pieces`` written once, then ``best_fit_pack``."""
    pieces = written(cut_pieces(docs, path, capacity, end, key, text), "pieces")
    return best_fit_pack(pieces, capacity, [key, "piece", "ids_crc32"])
