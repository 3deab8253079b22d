"""Turtle: a reader for the subset that ontologies and exports use, and a writer.

Triples are rows ``s, p, o, o_kind (uri, bnode or literal), datatype, lang``. There is no way to part a Turtle file, so one task parses a file from
its first line to its last; it holds a batch of lines and one statement at a time, whatever the file's size. Large graphs are faster as many files.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.uris import NAMESPACES

TRIPLE = "s string, p string, o string, o_kind string, datatype string, lang string"
_TOKEN = re.compile(
    r'''(?P<space>(?:\s+|\#[^\n]*)+)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\')|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')'''
    r"|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<blank>_:[\w.-]*\w)|(?P<number>[+-]?(?:\d+\.\d*(?:[eE][+-]?\d+)?|\.?\d+[eE][+-]?\d+|\.\d+|\d+)(?![\w:]))"
    r"|(?P<name>(?:[^\W\d_][\w.-]*)?:(?:[\w:%-](?:[\w.:%-]*[\w:%-])?)?|[A-Za-z]+)|(?P<mark>[.;,\[\]()])",
    re.S,
)
_ESCAPE = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
#: As many triples are sent on at once.
BATCH = 20_000
Triple = tuple[str, str, str, str, str | None, str | None]


class TurtleError(ValueError):
    """The text is not Turtle of the subset that is read."""


def _unescape(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPE[m[1]], text, flags=re.S)


class _Parser:
    """Of texts that follow each other, each but the last ending with a line: only space and long strings go on in the next."""

    def __init__(self, texts: Iterable[str]):
        self.tokens = self._scan(iter(texts))
        self.ahead: tuple[str, str] | None = None
        self.last, self.blanks = ("", ""), 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.out: list[Triple] = []

    @staticmethod
    def _scan(texts: Iterator[str]) -> Iterator[tuple[str, str]]:
        before = 0
        text = next(texts, None)
        while text is not None:
            at, following = 0, None
            while at < len(text):
                m = _TOKEN.match(text, at)
                if text.startswith(('"""', "'''"), at) and not (m and m.lastgroup == "long"):
                    more, size = [], len(text) - at
                    while size > 0 and (part := next(texts, None)) is not None:  # as much again, so that long strings aren't searched too often
                        more.append(part)
                        size -= len(part)
                    if more:
                        following = text[at:] + "".join(more)
                        break
                if not m:
                    raise TurtleError(f"unexpected text at {before + at}: {text[at : at + 30]!r}")
                if m.lastgroup != "space":
                    yield m.lastgroup, m[0]
                at = m.end()
            before += at
            text = next(texts, None) if following is None else following

    def next(self) -> tuple[str, str]:
        self.last = self.peek()
        self.ahead = None
        return self.last

    def peek(self) -> tuple[str, str]:
        if self.ahead is None:
            self.ahead = next(self.tokens, ("end", ""))
        return self.ahead

    def expect(self, mark: str) -> None:
        if self.next()[1] != mark:
            raise TurtleError(f"expected {mark!r} before {self.peek()[1]!r}")

    def iri(self, kind: str, text: str) -> str:
        if kind == "iri":
            body = _unescape(text[1:-1])
            return body if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", body) else self.base + body
        prefix, sep, local = text.partition(":")
        if kind != "name" or not sep or prefix not in self.prefixes:
            raise TurtleError(f"unknown name {text!r}")
        return self.prefixes[prefix] + local

    def fresh(self) -> str:
        self.blanks += 1
        return f"_:b{self.blanks}"

    def node(self) -> tuple[str, str, str | None, str | None]:
        """(value, kind, datatype, lang) of a subject or object."""
        kind, text = self.next()
        if kind in ("string", "long"):
            cut = 3 if kind == "long" else 1
            value = _unescape(text[cut:-cut])
            if self.peek()[0] == "lang":
                return value, "literal", None, self.next()[1][1:]
            if self.peek()[0] == "type":
                self.next()
                return value, "literal", self.iri(*self.next()), None
            return value, "literal", None, None
        xsd = NAMESPACES["xsd"]
        if kind == "number":
            name = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return text, "literal", xsd + name, None
        if text in ("true", "false"):
            return text, "literal", xsd + "boolean", None
        if kind == "blank":
            return text, "bnode", None, None
        if text == "[":
            name = self.fresh()
            if self.peek()[1] != "]":
                self.properties(name)
            self.expect("]")
            return name, "bnode", None, None
        if text == "(":
            return self.collection(), "uri", None, None
        return self.iri(kind, text), "uri", None, None

    def collection(self) -> str:
        rdf, head, last = NAMESPACES["rdf"], None, None
        while self.peek()[1] != ")":
            cell = self.fresh()
            if last:
                self.out.append((last, rdf + "rest", cell, "bnode", None, None))
            head, last = head or cell, cell
            value, kind, datatype, lang = self.node()
            self.out.append((cell, rdf + "first", value, kind, datatype, lang))
        self.next()
        if last:
            self.out.append((last, rdf + "rest", rdf + "nil", "uri", None, None))
        return head or rdf + "nil"

    def properties(self, subject: str) -> None:
        while True:
            kind, text = self.next()
            predicate = NAMESPACES["rdf"] + "type" if text == "a" else self.iri(kind, text)
            while True:
                value, of, datatype, lang = self.node()
                self.out.append((subject, predicate, value, of, datatype, lang))
                if self.peek()[1] != ",":
                    break
                self.next()
            while self.peek()[1] == ";":
                self.next()
            if self.last[1] != ";" or self.peek()[1] in (".", "]"):
                return

    def parse(self) -> Iterator[Triple]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            word = text.lstrip("@").lower()
            if word in ("prefix", "base") and (kind == "lang" or ":" not in text):
                self.next()
                if word == "prefix":
                    name = self.next()[1]
                    self.prefixes[name.rstrip(":")] = self.iri(*self.next())
                else:
                    self.base = self.iri(*self.next())
                if text.startswith("@"):
                    self.expect(".")
                continue
            subject, of, _, _ = self.node()
            if of == "literal":
                raise TurtleError("a literal can't be a subject")
            if self.peek()[1] != ".":
                self.properties(subject)
            self.expect(".")
            yield from self.out
            self.out.clear()


def parse_turtle(text: str) -> list[Triple]:
    """The triples of a Turtle text, in order."""
    return list(_Parser([text]).parse())


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    """(file, text) of runs of its lines."""
    for batch in batches:
        for name, lines in groupby(zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True), lambda x: x[0]):
            yield name, "".join(f"{line}\n" for _, line in lines)


def read_turtle(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Triples of Turtle files, with ``source_file``. Blank nodes are named by file, so files never share one. Paths may not overlap.

    Lines are dealt out by file and sorted as they stand in it, so that a file is never held whole.
    """
    paths = path if isinstance(path, str) else list(dict.fromkeys(path))
    lines = spark.read.text(paths, lineSep="\n").select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    files = lines.repartition(F.col("source_file")).sortWithinPartitions("source_file", "start", "n").select("value", "source_file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, texts in groupby(_pieces(batches), lambda x: x[0]):
            found = _Parser(text for _, text in texts).parse()
            while triples := list(islice(found, BATCH)):
                columns = zip(*triples, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array([name] * len(triples), pa.string())], names=["s", "p", "o", "o_kind", "datatype", "lang", "source_file"])

    out = files.mapInArrow(run, TRIPLE + ", source_file string")
    local = lambda c: F.concat(c, F.lit("."), F.substring(F.sha2("source_file", 256), 1, 8))
    return out.withColumn("s", F.when(F.col("s").startswith("_:"), local(F.col("s"))).otherwise(F.col("s"))).withColumn(
        "o", F.when(F.col("o_kind") == "bnode", local(F.col("o"))).otherwise(F.col("o"))
    )


def _quoted(c: Column) -> Column:
    for raw, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(mark))
    return F.concat(F.lit('"'), c, F.lit('"'))


def term(value: Column, kind: Column, datatype: Column, lang: Column) -> Column:
    """A term as Turtle writes it."""
    tagged = F.when(lang.isNotNull(), F.concat(F.lit("@"), lang)).when(datatype.isNotNull(), F.concat(F.lit("^^<"), datatype, F.lit(">"))).otherwise(F.lit(""))
    return F.when(kind == "uri", F.concat(F.lit("<"), value, F.lit(">"))).when(kind == "bnode", value).otherwise(F.concat(_quoted(value), tagged))


def to_turtle(triples: DataFrame) -> DataFrame:
    """One row per subject: ``s`` and ``text``, its block of Turtle with sorted predicates and objects."""
    said = triples.select(
        "s", F.concat(F.lit("<"), "p", F.lit(">")).alias("p"), term(F.col("o"), F.col("o_kind"), F.col("datatype"), F.col("lang")).alias("o")
    ).distinct()
    lines = said.groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_list("o")), ", ").alias("o"))
    block = lines.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "p", "o"))), " ;\n    ").alias("body"))
    subject = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(F.concat(F.lit("<"), "s", F.lit(">")))
    return block.select("s", F.concat(subject, F.lit("\n    "), "body", F.lit(" .")).alias("text"))


def write_turtle(triples: DataFrame, path: str) -> None:
    """Turtle files, one per partition."""
    to_turtle(triples).select("text").write.mode("overwrite").text(path)
