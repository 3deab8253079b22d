"""Text functions: slugs, cleaning, keys, tokens, similarity, answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with accents or strokes, and what they become in slugs.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāăąćčďđēĕęěğģīįķļłńņňōőŕřśşšţťūůűųźżžÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŸĀĂĄĆČĎĐĒĔĘĚĞĢĪĮĶĻŁŃŅŇŌŐŔŘŚŞŠŢŤŪŮŰŲŹŻŽ"
FOLD_TO = "aaaaaaceeeeiiiinoooooouuuuyyaaaccddeeeeggiikllnnnoorrsssttuuuuzzzAAAAAACEEEEIIIINOOOOOOUUUUYYAAACCDDEEEEGGIIKLLNNNOORRSSSTTUUUUZZZ"
#: Values that count as missing when a matrix is turned into rows.
MISSING = ("", "NA", "N/A", "NULL", "None")


def ascii_fold(c: Column) -> Column:
    """Latin letters without their accents."""
    return F.translate(c, FOLD_FROM, FOLD_TO)


def slug(c: Column, joint: str = "-") -> Column:
    """Lower-case ASCII words joined by ``joint``; apostrophes vanish, and so do commas between digits."""
    text = F.lower(ascii_fold(c))
    text = F.regexp_replace(F.regexp_replace(text, "'", ""), r"([0-9]),(?=[0-9])", "$1")
    return F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9]+", joint), f"^{joint}+|{joint}+$", "")


def attribute_id(name: Column, index: Column) -> Column:
    """Identifier of a column: its slug with ``_`` (``col`` if empty, a leading digit escaped), always with its index."""
    base = slug(name, "_")
    base = F.when(base == "", F.lit("col")).when(base.rlike("^[0-9]"), F.concat(F.lit("_"), base)).otherwise(base)
    return F.concat_ws("_", base, index.cast("string"))


def clean_cell(c: Column) -> Column:
    """A cell's text on one line, without selection marks, trimmed."""
    return F.trim(F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit(":unselected:"), F.lit("")))


def escape_newlines(c: Column) -> Column:
    """Newlines as the two characters backslash and n, so that a value fits on a line."""
    return F.replace(c, F.lit("\n"), F.lit("\\n"))


def unescape_newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\\n"), F.lit("\n"))


def split_plus(c: Column) -> Column:
    """The parts of ``A+B``; a value without ``+`` is its own only part."""
    return F.split(c, r"\+", -1)


def unit_tokens(c: Column) -> Column:
    """Tokens of a unit or commodity text: split at single spaces; a text without a space is parted at a leading or trailing %."""
    parted = (
        F.when(F.instr(c, " ") > 0, c)
        .when(c.rlike("(?s)^%.+"), F.concat(F.lit("% "), F.substring(c, 2, 1 << 30)))
        .when(c.rlike("(?s).+%$"), F.concat(F.expr("''"), F.regexp_replace(c, r"%\z", " %")))
        .otherwise(c)
    )
    return F.split(parted, " ", -1)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length, in code points; 1.0 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def short_hash(c: Column) -> Column:
    """The first eight characters of the base64 SHA-256."""
    return F.substring(F.base64(F.unhex(F.sha2(c, 256))), 1, 8)


def expand_range(pattern: Column) -> Column:
    """``...{a}-{b}...`` as an array of strings with a, a + 1, ..., b - 1 in its place; others as their own only item."""
    rx = r"^(.*)\{([0-9]+)\}-\{([0-9]+)\}(.*)$"
    low, high = (F.regexp_extract(pattern, rx, i).cast("int") for i in (2, 3))
    items = F.transform(
        F.sequence(low, F.greatest(high - 1, low)), lambda i: F.concat(F.regexp_extract(pattern, rx, 1), i.cast("string"), F.regexp_extract(pattern, rx, 4))
    )
    empty = F.expr("cast(array() as array<string>)")
    return F.when(pattern.rlike(rx), F.when(high > low, items).otherwise(empty)).otherwise(F.array(pattern))


def extract_answer(c: Column) -> Column:
    """The earliest quoted or back-ticked span of an answer; null if the answer says not available, or holds no such span."""
    first = F.regexp_extract(c, "\"([^\"]*)\"|'([^']*)'|`([^`]*)`", 0)
    span = F.substring(first, 2, F.length(first) - 2)
    return F.when(c.rlike("N/A|n/a|N/a") | (first == ""), F.lit(None).cast("string")).otherwise(span)


def composite_key(*parts: Column) -> Column:
    """The parts joined by ``__``, blank parts kept as blanks; null if all are blank."""
    blank = F.lit(True)
    for p in parts:
        blank = blank & (F.coalesce(F.trim(p), F.lit("")) == "")
    return F.when(~blank, F.concat_ws("__", *(F.coalesce(p, F.lit("")) for p in parts)))


def template_uri(prefix: str, *parts: Column, missing: tuple[str, ...] = ("", "0.0")) -> Column:
    """``prefix__part__...`` with slugs of the parts; null if the last part is one of ``missing``."""
    last = parts[-1]
    return F.when(~last.isin(*missing), F.concat_ws("__", F.lit(prefix), *(slug(p) for p in parts)))


def keyword_entity(c: Column, keyword: str, entity: str) -> Column:
    """``entity`` where the text holds ``keyword`` in any case."""
    return F.when(F.lower(c).contains(keyword.lower()), F.lit(entity))


def content_key(*columns: Column) -> Column:
    """SHA-256 of the columns' JSON: the fingerprint of a row."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
