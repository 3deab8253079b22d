"""Secret scans in DataFrame functions only: pattern kinds, and sliding-window entropy.

Pattern matches are cut out by ``split`` and ``regexp_extract_all`` with one pattern; their places follow from the
lengths of the pieces between them (two-level prefix sums, so that many matches in one text stay near linear).

Entropy: candidates are runs of token characters. The first character class (hex digits; capitals or small letters with digits; all token
characters) that covers a candidate sets the threshold. A window slides over the candidate: at each step the character that leaves and the one that comes are counted
among those that stay, one count goes down and one up, and the sum of c * log2(c) follows, whatever the size of the class. A candidate is reported if some window reaches the
class's threshold, unless the allow-list suppresses it. Pattern spans are never suppressed.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import no_reserved

#: Patterns by kind with the least size of what counts (of group 2 for assign, of the match otherwise).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # maximal runs either way, so the least size can be part of the pattern
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "entropy")
#: Candidates for entropy, and what is never reported: plain words, words joined by _ or -, paths, dates, one repeated character.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALLOWED = r"(?s)^(?:[A-Za-z]+|[A-Za-z]*(?:[_/=+-]+[A-Za-z]*)+|[0-9]+(?:[-_/][0-9]+)*|.*EXAMPLE.*)$"
#: Class -> (pattern of the whole candidate, threshold in bits for one window). No window has exactly a threshold's entropy.
CLASSES = {"hex": ("^[0-9a-fA-F]+$", 3.05), "upper": ("^[A-Z0-9]+$", 3.45), "lower": ("^[a-z0-9]+$", 3.45), "token": ("^[A-Za-z0-9+/_=-]+$", 3.75)}
WINDOW, BLOCK = 20, 256


def _prefix(lengths: Column) -> Column:
    """Exclusive prefix sums of an array, by blocks."""
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(lengths) / BLOCK).cast("int") - 1), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))
    zero = F.lit(0).cast("long")
    total = lambda xs: F.aggregate(xs, zero, lambda a, x: a + x)
    sums = lambda xs, first: F.aggregate(xs, F.array(first), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    starts = sums(F.transform(blocks, total), zero)
    return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda b, s: F.slice(sums(b, s), 1, F.size(b))))


def _places(df: DataFrame, text: str, kind: str, pattern: str, keep=None) -> DataFrame:
    """Add column ``kind``: array of (start, end, value) of the matches of ``pattern`` that pass ``keep(match, group 2)``."""
    rx, m, g, v, s = F.lit(pattern), f"__m_{kind}", f"__g_{kind}", f"__v_{kind}", f"__s_{kind}"
    span = "array<struct<start:long,end:long,value:string>>"
    df = df.withColumn(m, F.regexp_extract_all(text, rx, F.lit(0)))
    if keep == "group":
        df = df.withColumn(v, F.regexp_extract_all(text, rx, F.lit(2)))
    df = df.withColumn(g, F.when(F.size(m) > 0, F.split(text, pattern, -1)))
    # gap 0, match 0, gap 1, match 1, ... : a match starts at the sum of all before it
    steps = F.zip_with(F.slice(g, 1, F.size(m)), m, lambda gap, hit: F.length(gap).cast("long") + F.length(hit))
    df = df.withColumn(s, F.when(F.size(m) > 0, _prefix(steps)))
    spans = F.transform(
        F.arrays_zip(F.col(s).alias("b"), F.slice(g, 1, F.size(m)).alias("gap"), F.col(m).alias("hit"), F.col(v if keep == "group" else m).alias("val")),
        lambda x: F.struct(
            (x["b"] + F.length(x["gap"])).alias("start"), (x["b"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), x["val"].alias("value")
        ),
    )
    if keep == "group":
        spans = F.filter(spans, lambda x: F.length(x["value"]) >= ASSIGN_LEAST)
    elif keep:
        spans = F.filter(spans, lambda x: x["end"] - x["start"] >= keep)
    found = F.when(F.size(m) > 0, spans).otherwise(F.expr("array()").cast(span))
    return df.withColumn(kind, found.cast(span)).drop(m, g, v, s)


def _peak(value: Column) -> Column:
    """The largest entropy, in bits, of any window of ``value``; shorter values count as one window."""
    n = F.least(F.length(value), F.lit(WINDOW)).cast("double")
    chars = F.split(value, "")
    table = F.array(*(F.lit(c * log2(c) if c else 0.0) for c in range(WINDOW + 1)))  # c * log2(c)
    term = lambda c: F.element_at(table, c + 1)

    def step(acc: Column, i: Column) -> Column:
        stay = F.slice(chars, F.greatest(i - (WINDOW - 2), F.lit(1)), F.least(i, F.lit(WINDOW - 1)))
        among = lambda c: F.size(stay) - F.size(F.array_remove(stay, c))
        up, down = among(F.element_at(chars, i + 1)), among(F.element_at(chars, F.greatest(i - (WINDOW - 1), F.lit(1))))
        gone = F.when(i >= WINDOW, term(down) - term(down + 1)).otherwise(F.lit(0.0))
        total = acc["total"] + gone + term(up + 1) - term(up)
        return F.struct(total.alias("total"), F.when(i + 1 >= n, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))

    start = F.struct(F.lit(0.0).alias("total"), F.lit(1e9).alias("least"))
    least = F.aggregate(F.sequence(F.lit(0), F.length(value) - 1), start, step, lambda acc: acc["least"])
    return F.log2(n) - least / n


def scan_secrets(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Add ``out``: array of (start, end, kind, value) of all spans in ``text``, by start, then kind as in ``KINDS``.

    Places count code points, ends exclusive. Null texts count as empty. Other columns stay (names that begin with
    ``__`` raise an error), an existing ``out`` is replaced; rows are independent of each other.
    """
    names = no_reserved(df.drop(out)).columns
    kinds = {k: f"__{k}" for k in KINDS}
    work = df.select(*names, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    work = _places(work, "__text", kinds["assign"], ASSIGN, "group")
    work = _places(work, "__text", kinds["access"], ACCESS, ACCESS_LEAST)
    work = _places(work, "__text", kinds["hex"], HEX)
    work = _places(work, "__text", kinds["entropy"], CANDIDATE)

    def odd(x: Column) -> Column:
        least = F.lit(1e9)
        for pattern, bits in reversed(CLASSES.values()):
            least = F.when(x["value"].rlike(pattern), F.lit(bits)).otherwise(least)
        return ~x["value"].rlike(ALLOWED) & (_peak(x["value"]) >= least)

    work = work.withColumn(kinds["entropy"], F.filter(kinds["entropy"], odd))
    def tagged(order: int, kind: str) -> Column:
        return F.transform(
            kinds[kind],
            lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")),
        )

    every = F.array_sort(F.concat(*(tagged(i, k) for i, k in enumerate(KINDS))))
    spans = F.transform(every, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value")))
    return work.select(*names, spans.alias(out))


def redact(text: str | Column, spans: str | Column) -> Column:
    """``text`` with every span of ``spans`` (as ``scan_secrets`` returns them) replaced by ``[kind]``; overlaps become one."""
    text, spans = (F.col(x) if isinstance(x, str) else x for x in (text, spans))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        new = x["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(new, F.concat(acc["parts"], F.array(gap, F.concat(F.lit("["), x["kind"], F.lit("]"))))).otherwise(acc["parts"]).alias("parts"),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))
    done = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, done)).otherwise(text)


def secret_digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, the number of spans of each pattern kind, base_sha256 and spans, and the number of those by entropy."""
    scanned = scan_secrets(df.select(F.col(key).cast("long").alias(key), text), text, "__spans")
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("__spans", lambda x: x["kind"] != "entropy")
    counted = lambda kind: F.size(F.filter("__spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        key,
        *map(counted, KINDS[:3]),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("__spans", line), ",").alias("spans"),
        counted("entropy"),
    )
