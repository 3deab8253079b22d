"""Byte-level BPE encoding in linear time, and decoding.

Bytes are mapped one to one to Latin-1 characters so that a pyahocorasick automaton over the vocabulary finds, in one
scan of a piece, the longest token that starts at each byte. The encoder takes the longest token that is
*compatible* with the one before it and steps back where none is; a position that turned out to be a dead end is never
tried again, so the work is linear in the piece. Two adjacent tokens are compatible if encoding their joined bytes
by merges gives just these two tokens; that test is memoised by pair. A sequence whose neighbours
are all compatible is the merge result, and there is exactly one.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkTable, split_chunks
from .common import map_arrow


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class LinearBpe:
    """Exact BPE over ``ranks``; every single byte has to be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.token = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        if not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        # by rising rank: the two tokens whose merge makes a token are known before it is needed
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (pair := self._last_merge(token, rank)):
                self.halves[rank] = pair
                self.merged[pair] = rank
        self.prefix: dict[int, int] = {}
        for token, rank in ranks.items():
            for n in range(len(token) - 1, 0, -1):
                if (shorter := ranks.get(token[:n])) is not None:
                    self.prefix[rank] = shorter
                    break
        self.compatible = lru_cache(1 << 18)(self._compatible)
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        parts = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 2:
            best = min((m, i) for i in range(len(parts) - 1) if (m := self.merged.get((parts[i], parts[i + 1]), 1 << 60)) is not None)
            if best[0] >= rank:
                return None
            parts[best[1] : best[1] + 2] = [best[0]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _compatible(self, left: int, right: int) -> bool:
        """Whether no merge across the border of two tokens comes before the merges that made them."""
        below = 1 << 60
        while True:
            merge = self.merged.get((left, right))
            if merge is not None and merge < below:
                return False
            # undo the younger of the two merges beside the border; the other one if that token is a single byte
            undo_left = left > right
            for _ in range(2):
                if undo_left and left in self.halves:
                    below, left = left, self.halves[left][1]
                    break
                if not undo_left and right in self.halves:
                    below, right = right + 1, self.halves[right][0]
                    break
                undo_left = not undo_left
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = [0] * len(piece)
        for end, (before, rank) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - before] = rank  # matches come by rising end: the last one from a start is the longest
        out: list[int] = []
        open_at = bytearray(b"\1") * (len(piece) + 1)
        at, token = 0, longest[0]
        while True:
            end = at + self.length[token]
            if open_at[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == len(piece):
                    return out
                token = longest[at]
            elif token in self.prefix:
                token = self.prefix[token]
            else:
                open_at[at] = 0
                token = out.pop()
                at -= self.length[token]

    def encode(self, text: str) -> list[int]:
        """The ids of a text, piece by piece."""
        out: list[int] = []
        known = self.pieces
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                ids = tuple(self.encode_piece(piece.encode("utf-8")))
                if len(piece) <= 64:
                    if len(known) >= 200_000:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ``ids``."""
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(2)
def _coder(path: str, pattern: str) -> tuple[LinearBpe, ChunkTable]:
    coder = LinearBpe(load_ranks(path), pattern)
    return coder, ChunkTable(lambda chunk: " ".join(map(str, coder.encode(chunk))).encode() + b" ")


def bpe_encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: the token ids of column ``text`` (null counts as empty; an empty text has no ids).

    Other columns stay as they are; an existing column named ``out`` is replaced. Rows are independent, so repeated
    rows and an empty table need nothing special.
    """
    plain = df.drop(out)
    names = plain.columns

    def run(batches):
        for batch in batches:
            coder, _ = _coder(path, pattern)
            ids = [coder.encode(t or "") for t in batch.column(names.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*names, out])

    return plain.mapInArrow(run, plain.withColumn(out, F.expr("cast(array() as array<int>)")).schema)


def bpe_decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes of the token ids in column ``ids`` (null stays null)."""
    plain = df.drop(out)
    names = plain.columns

    def run(batches):
        for batch in batches:
            coder, _ = _coder(path, pattern)
            got = [None if x is None else coder.decode(x) for x in batch.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=[*names, out])

    return plain.mapInArrow(run, plain.withColumn(out, F.lit(b"")).schema)


def bpe_digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256 (the decoded ids).

    The same coder as ``bpe_encode``; ids of chunks between spaces are kept in a bounded table, as decimals. Null and
    empty texts have no tokens and the digests of the empty string.
    """

    def run(batch: dict[str, list]) -> dict[str, list]:
        coder, table = _coder(path, pattern)
        n, ids_sha, decoded_sha = [], [], []
        for t in batch[text]:
            chunks = split_chunks(t or "")
            if chunks is None:
                packed = " ".join(map(str, coder.encode(t))).encode()
            else:
                packed = table.join(chunks)[:-1]
            ids = list(map(int, packed.split()))
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(packed).hexdigest())
            decoded_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
        return {key: batch[key], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": decoded_sha}

    schema = f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    arrow = pa.schema([(key, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return map_arrow(df.select(F.col(key).cast("long").alias(key), text), run, schema, arrow)
