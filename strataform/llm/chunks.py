"""Cutting a text at spaces where every token boundary of the pre-tokenizer pattern falls anyway.

The pattern of the public byte-level tokenizers lets a token *start* with one space but never holds a
space after another character. So if no space touches other white space, each chunk "one leading
space + text up to the next space" is tokenized on its own with the same result. Chunks repeat
a lot, so their results are kept in a bounded table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: A space beside other white space (of any script): such texts are tokenized whole.
TOUCHING = re.compile(r" \s|\s ")


def split_chunks(text: str) -> list[str] | None:
    """The chunks of ``text`` (joined, they give it back), or None where it must be tokenized whole."""
    if TOUCHING.search(text):
        return None
    first, *rest = text.split(" ")
    out = [" " + x for x in rest]
    if first:
        out.insert(0, first)
    return out


class ChunkTable(dict):
    """chunk -> packed result, filled by ``compute`` and emptied beyond ``limit`` entries."""

    def __init__(self, compute: Callable[[str], bytes], limit: int = 700_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest = compute, limit, longest

    def __missing__(self, chunk: str) -> bytes:
        value = self.compute(chunk)
        if len(chunk) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = value
        return value

    def join(self, chunks: Iterable[str]) -> bytes:
        """The results of all chunks, concatenated."""
        return b"".join(map(self.__getitem__, chunks))
