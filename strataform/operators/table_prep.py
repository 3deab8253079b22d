"""Preparing human-made tables: ranges, cleaning, headers, and turning matrices into rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import MISSING, clean_cell
from ..functions.values import drop_digit_groups

Groups = dict[str, list[int]]


def column_number(spec: int | str) -> int:
    """The index (from 0) of a spreadsheet column: letters (``A`` is 0, ``BO`` is 66) or a number, which is the index itself."""
    if isinstance(spec, int) or str(spec).isdigit():
        return int(spec)
    out = 0
    for letter in spec.upper():
        if not "A" <= letter <= "Z":
            raise ValueError(f"not a column: {spec!r}")
        out = 26 * out + ord(letter) - 64
    return out - 1


def select_range(cells: DataFrame, start_row: int = 0, end_row: int | None = None, start_col: int | str = 0, end_col: int | str | None = None) -> DataFrame:
    """The cells of a rectangle, renumbered from 0. Ends are exclusive; an open end reaches as far as the table does.

    An end column in letters is included, as in spreadsheet ranges.
    """
    first = column_number(start_col)
    keep = (F.col("row") >= start_row) & (F.col("col") >= first)
    if end_row is not None:
        keep &= F.col("row") < end_row
    if end_col is not None:
        stop = column_number(end_col) + (isinstance(end_col, str) and not end_col.isdigit())
        keep &= F.col("col") < stop
    return cells.where(keep).withColumns({"row": F.col("row") - start_row, "col": F.col("col") - first})


def normalise(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Line ends as ``\\n`` and digit groups without commas, in all (or the given) string columns."""
    names = columns or [c for c, kind in df.dtypes if kind == "string"]
    return df.withColumns({c: drop_digit_groups(F.regexp_replace(c, r"\r\n?", "\n")) for c in names})


def parse_columns(spec: str | Mapping[str, Sequence[int]], ncols: int) -> Groups:
    """Named groups of column indices.

    ``"1,2,3"`` and ``"6:27"`` are one group named ``""``; several ranges, ``"1:5,9:"``, are groups g0, g1, ...; an open
    end is the last column; ends are included; indices that don't exist are skipped. A mapping passes through. A single index
    is a group of one; ``"1,2:5"`` mixes both: its parts are groups of their own.
    """
    if isinstance(spec, Mapping):
        return {k: [i for i in v if i < ncols] for k, v in spec.items()}
    parts = [p.strip() for p in spec.split(",") if p.strip()]
    if not parts or not all(re.fullmatch(r"\d+(:\d*)?", p) for p in parts):
        raise ValueError(f"not columns: {spec!r}")

    def span(part: str) -> list[int]:
        low, colon, high = part.partition(":")
        last = int(high) if high else (ncols - 1 if colon else int(low))
        return list(range(int(low), min(last, ncols - 1) + 1))

    if not any(":" in p for p in parts):
        return {"": [i for p in parts for i in span(p)]}
    return {"": span(parts[0])} if len(parts) == 1 else {f"g{k}": span(p) for k, p in enumerate(parts)}


def matrix_to_rows(df: DataFrame, groups: Mapping[str, Sequence[str]], missing: Sequence[str] = MISSING, index: str = "row_index") -> DataFrame:
    """One row for each cell of the groups' columns that isn't missing.

    Kept columns stand beside ``{group}_attrs`` (the cell's column) and ``{group}_attr_values``. Groups are united, not multiplied: a row of
    one group has nulls in the columns of the others. A row without any value disappears. ``index`` has to be
    in ``df`` (see ``with_row_index``). One pass over the input, no shuffle: the cells of a row are exploded where they are.
    """
    used = {c for cols in groups.values() for c in cols}
    kept = [c for c in df.columns if c not in used and c != index]
    null = F.lit(None).cast("string")
    fields = lambda g, name, value: [
        x for k in groups for x in ((name if k == g else null).alias(f"{k}_attrs"), (value if k == g else null).alias(f"{k}_attr_values"))
    ]
    items = [
        F.struct(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("__v"), *fields(g, F.lit(c), F.col(f"`{c}`").cast("string")))
        for g, cols in groups.items() for c in cols
    ]
    if not items:
        return df.limit(0)
    # the filter stays outside the array: higher-order functions would break code generation
    return df.select(index, *(F.col(f"`{c}`") for c in kept), F.inline(F.array(*items))).where(~F.col("__v").isin(*missing)).drop("__v")


def headers_to_rows(cells: DataFrame, attributes: Sequence[Mapping], header_rows: int) -> DataFrame:
    """Matrix cells with header rows as attributes: table_id, row, range, col, attributes (map), value.

    ``attributes`` lists {row, cols: (first, last)}: header ``row`` holds an attribute of the cells in those columns. Several rows over one
    range give several attributes; several ranges are several groups of measures.
    """
    spans = sorted({tuple(a["cols"]) for a in attributes})
    which = F.lit(None).cast("int")
    for k, (lo, hi) in enumerate(spans):
        which = F.when(F.col("col").between(lo, hi), F.lit(k)).otherwise(which)
    body = cells.where(F.col("row") >= header_rows).withColumn("range", which).where(F.col("range").isNotNull() & ~F.col("value").isin(*MISSING))
    own = F.lit(False)
    for a in attributes:
        own |= (F.col("row") == a["row"]) & F.col("col").between(*a["cols"])
    heads = cells.where(own).groupBy("table_id", "col").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.format_string("row%d", "row").alias("k"), F.col("value").alias("v"))))).alias("attributes")
    )
    return body.join(heads, ["table_id", "col"], "left").select("table_id", (F.col("row") - header_rows).alias("row"), "range", "col", "attributes", "value")


def repeated_blocks(cells: DataFrame, start_col: int, width: int, repeat: int, key_col: int, start_row: int, header_row: int | None = None) -> DataFrame:
    """Blocks of ``width`` columns repeated side by side, as rows: table_id, row, block, key, header, values (array by offset).

    ``key_col`` is the column of the row's own key; ``header_row`` holds each block's title in its first column.
    """
    inside = cells.where((F.col("col") >= start_col) & (F.col("col") < start_col + width * repeat))
    block = F.floor((F.col("col") - start_col) / width).cast("int")
    offset = F.pmod(F.col("col") - start_col, F.lit(width))
    body = inside.where(F.col("row") >= start_row).groupBy("table_id", "row", block.alias("block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(offset.alias("o"), F.col("value").alias("v")))), lambda x: x["v"]).alias("values")
    )
    body = body.where(F.exists("values", lambda v: ~v.isin(*MISSING)))
    keys = cells.where((F.col("col") == key_col) & (F.col("row") >= start_row)).select("table_id", "row", F.col("value").alias("key"))
    out = body.join(keys, ["table_id", "row"], "left")
    if header_row is None:
        return out.select("table_id", (F.col("row") - start_row).alias("row"), "block", "key", F.lit(None).cast("string").alias("header"), "values")
    titles = inside.where((F.col("row") == header_row) & (offset == 0)).select("table_id", block.alias("block"), F.col("value").alias("header"))
    return out.join(titles, ["table_id", "block"], "left").select("table_id", (F.col("row") - start_row).alias("row"), "block", "key", "header", "values")


def fill_spans(spans: DataFrame) -> DataFrame:
    """Cells of an analysed page: each span's cleaned content at every place that it covers; where spans overlap the later one stays.

    In: table_id, pos (order of the spans), row, col, row_span, col_span, kind, content. Out: cells.
    """
    rows = F.sequence(F.col("row"), F.col("row") + F.coalesce("row_span", F.lit(1)) - 1)
    cols = F.sequence(F.col("col"), F.col("col") + F.coalesce("col_span", F.lit(1)) - 1)
    said = F.struct("pos", "kind", clean_cell(F.col("content")).alias("value"))
    placed = spans.select("table_id", said.alias("x"), F.explode(rows).alias("row"), "col", "col_span")
    placed = placed.select("table_id", "x", "row", F.explode(F.sequence(F.col("col"), F.col("col") + F.coalesce("col_span", F.lit(1)) - 1)).alias("col"))
    last = placed.groupBy("table_id", "row", "col").agg(F.max("x").alias("x"))
    return last.select("table_id", "row", "col", F.col("x.kind").alias("kind"), F.col("x.value").alias("value"))


def merge_headers(cells: DataFrame) -> DataFrame:
    """Cells with one header row: leading rows of headers become row 0, each column's distinct texts joined by a space.

    That is done where there are several such rows and the next one is all content; tables of headers alone, and
    others, stay as they are. Rows are renumbered.
    """
    every = cells.groupBy("table_id", "row").agg(
        F.every(F.col("kind") == "columnHeader").alias("head"), F.every(F.coalesce(F.col("kind"), F.lit("content")) != "columnHeader").alias("body")
    )
    tables = every.groupBy("table_id").agg(F.min(F.when(~F.col("head"), F.col("row"))).alias("n"))
    after = every.select("table_id", F.col("row").alias("n"), "body")
    plan = tables.join(after, ["table_id", "n"], "left").select("table_id", F.when((F.col("n") > 1) & F.col("body"), F.col("n")).otherwise(0).alias("n"))
    joined = cells.join(plan, "table_id")
    top = joined.where(F.col("row") < F.col("n")).groupBy("table_id", "col").agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("v"))
    texts = F.array_distinct(F.transform("v", lambda x: x["value"]))
    top = top.select("table_id", F.lit(0).alias("row"), "col", F.lit("columnHeader").alias("kind"), F.array_join(texts, " ").alias("value"))
    rest = joined.where(F.col("row") >= F.col("n")).select("table_id", (F.col("row") - F.greatest(F.col("n") - 1, F.lit(0))).alias("row"), "col", "kind", "value")
    return top.unionByName(rest)


def promote_headers(cells: DataFrame, header_rows: int = 1) -> tuple[DataFrame, DataFrame]:
    """(columns, body): names from the first rows, joined by a space, and the cells below, renumbered.

    A column without a name is called ``Column N``. ``columns`` has table_id, col_index, name, clean_name (one line, trimmed).
    """
    heads = cells.where(F.col("row") < header_rows).groupBy("table_id", "col").agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("v"))
    name = F.array_join(F.filter(F.transform("v", lambda x: x["value"]), lambda v: F.trim(v) != ""), " ")
    every = cells.select("table_id", "col").distinct().join(heads, ["table_id", "col"], "left")
    names = every.select("table_id", F.col("col").alias("col_index"), F.coalesce(name, F.lit("")).alias("name"))
    names = names.withColumn("name", F.when(F.col("name") == "", F.concat(F.lit("Column "), F.col("col_index").cast("string"))).otherwise(F.col("name")))
    clean = names.withColumn("clean_name", F.trim(F.regexp_replace("name", r"\s+", " ")))
    return clean, cells.where(F.col("row") >= header_rows).withColumn("row", F.col("row") - header_rows)


def remove_columns(df: DataFrame, indices: Sequence[int]) -> DataFrame:
    """``df`` without the columns at these places; places that don't exist are skipped."""
    return df.select(*(F.col(f"`{c}`") for i, c in enumerate(df.columns) if i not in set(indices)))


def keep_columns(df: DataFrame, indices: Sequence[int]) -> DataFrame:
    """``df`` with the columns at these places only."""
    return df.select(*(F.col(f"`{df.columns[i]}`") for i in indices))


def drop_blank(cells: DataFrame, value: str = "value") -> DataFrame:
    """Cells that hold something; the rest of a row stays where it is, as cells are apart anyway."""
    return cells.where(F.trim(F.coalesce(value, F.lit(""))) != "")


def sample_rows(df: DataFrame, n: int, by: Sequence[str] = (), seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """At most ``n`` rows (of each group ``by``), the same ones on every run: by a hash of ``key`` (all columns unless given)."""
    cols = list(key or df.columns)
    order = F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c in cols))
    if not by:
        return df.orderBy(order, *(F.col(f"`{c}`") for c in cols)).limit(n)
    window = Window.partitionBy(*by).orderBy(order, *(F.col(f"`{c}`") for c in cols))
    return df.withColumn("__n", F.row_number().over(window)).where(F.col("__n") <= n).drop("__n")


def shorten_until(df: DataFrame, order: Sequence[str], attempt: Callable[[DataFrame], object], rows: int, floor: int = 5, step: int = 10, tries: int = 9) -> object:
    """The result of ``attempt`` on the first rows: fewer by ``step`` more each time it raises OverflowError, not under ``floor``."""
    for k in range(tries):
        try:
            return attempt(df.orderBy(*order).limit(max(floor, rows - step * k)))
        except OverflowError:
            if rows - step * k <= floor:
                break
    raise OverflowError(f"still too long with {floor} rows")


def parse_ops(text: str) -> list[tuple[str, dict]]:
    """(name, arguments) of operations ``name{json}`` parted by ``|``. Bars inside the JSON are part of it."""
    out, at, decoder = [], 0, json.JSONDecoder()
    while at < len(text):
        m = re.compile(r"[\s|]*([A-Za-z_]\w*)\s*").match(text, at)
        if not m:
            if text[at:].strip(" |\n\t"):
                raise ValueError(f"not an operation: {text[at:]!r}")
            break
        at, args = m.end(), {}
        if text[at : at + 1] == "{":
            args, at = decoder.raw_decode(text, at)
        out.append((m[1], args))
    return out


def run_ops(df: DataFrame, text: str, joins: Callable[[DataFrame, dict], DataFrame] | None = None) -> DataFrame:
    """Apply parsed operations in turn: ``norm_table``, ``remove_cols {cols}``, ``matrix2relational {cols, missing}``, ``join_table``."""
    for name, args in parse_ops(text):
        if name == "norm_table":
            df = normalise(df)
        elif name == "remove_cols":
            df = remove_columns(df, [i for g in parse_columns(args["cols"], len(df.columns)).values() for i in g])
        elif name == "matrix2relational":
            groups = parse_columns(args["cols"], len(df.columns))
            df = matrix_to_rows(df, {g: [df.columns[i] for i in cols] for g, cols in groups.items()}, args.get("missing", MISSING))
        elif name == "join_table" and joins:
            df = joins(df, args)
        else:
            raise ValueError(f"unknown operation: {name}")
    return df


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """(``df`` with columns c0 .. cN, the names they had): for tables whose names repeat."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), df.columns


def spread(cells: DataFrame, columns: int, keys: Sequence[str] = ("table_id", "row")) -> DataFrame:
    """Cells as rows with columns c0 .. c(columns - 1); cells that aren't there are ``""``."""
    at = lambda i: F.coalesce(F.max(F.when(F.col("col") == i, F.col("value"))), F.lit("")).alias(f"c{i}")
    return cells.groupBy(*keys).agg(*map(at, range(columns)))


def cell_expression(expr: Column, missing: Sequence[str] = ("", "0.0")) -> Column:
    """``expr`` with a mapping file's own missing values as null."""
    return F.when(~expr.isin(*missing), expr)
