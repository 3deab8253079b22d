"""Line dedup by overlapping windows of lines, in DataFrame functions only.

Every run of ``WINDOW`` consecutive lines is hashed (MD5 of the lines joined). A window whose hash occurs before, in the
order of (key, position), is a later occurrence; the lines of all later occurrences in a document are merged
and removed. Two scans of the texts and one exchange of them; hashes of a frequent window are counted before the
shuffle, and the join that marks later occurrences has plain exchanges on both sides, so AQE splits a frequent one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import no_reserved, written

WINDOW = 3


def _windows(lines: Column) -> Column:
    count = F.size(lines) - (WINDOW - 1)
    joined = lambda i: F.array_join(F.slice(lines, i + 1, WINDOW), "\n")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.unhex(F.md5(joined(i).cast("binary")))))


def repeated_windows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``__key``, ``__sig`` and ``__starts``: positions of the later windows of each document that has some."""
    sig = F.xxhash64(text)
    lines = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), sig.alias("__sig"), F.split(text, "\n", -1).alias("__lines"))
    found = lines.select("__key", "__sig", F.posexplode(_windows(F.col("__lines"))).alias("__at", "__hash"))
    found = written(found, "windows")
    place = F.struct("__key", "__at", "__sig")
    first = found.groupBy("__hash").agg(F.min(place).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    # a fresh key expression: the join gets exchanges of its own on both sides
    first = first.select(F.unhex(F.hex("__hash")).alias("__same"), "__first")
    later = found.join(first, found["__hash"] == first["__same"]).where(place != F.col("__first"))
    return later.groupBy("__key", "__sig").agg(F.collect_set("__at").alias("__starts"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", report: str | None = None) -> DataFrame:
    """``df`` with the lines of later windows taken out of ``text``.

    Lines are what ``\\n`` separates; a text of fewer than three has no window and stays whole. A null text stays null.
    Rows with a null key stay whole and count for nobody. Rows equal in key and text are the same document: each of them
    keeps or loses the same lines. Names that begin with ``__`` raise an error. With ``report``, a column
    of that name is added: struct of lines, removed and spans (maximal removed runs).
    """
    names = no_reserved(df).columns
    marks = repeated_windows(df, key, text)
    rows = df.withColumn("__own", F.xxhash64(text))
    joined = rows.join(marks, (F.col(key) == F.col("__key")) & (F.col("__own") == F.col("__sig")), "left")
    covered = F.array_distinct(F.flatten(F.transform("__starts", lambda p: F.sequence(p, p + (WINDOW - 1)))))
    work = joined.withColumn("__gone", F.when(F.col("__starts").isNotNull(), F.array_sort(covered)))
    lines = F.split(text, "\n", -1)
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone"), lambda i: F.element_at("__lines", i + 1)
    )
    work = work.withColumn("__lines", F.when(F.col("__gone").isNotNull(), lines))
    new = F.when(F.col("__gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text))
    out = [new.alias(text) if c == text else F.col(c) for c in names]
    if report:
        gone = F.col("__gone")
        starts = F.size(F.filter(gone, lambda p, i: (i == 0) | (F.element_at(gone, F.greatest(i, F.lit(1))) + 1 != p)))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
        n = F.size(lines).cast("long")
        fact = F.struct(zero(n).alias("lines"), zero(F.when(gone.isNotNull(), F.size(gone))).alias("removed"), zero(F.when(gone.isNotNull(), starts)).alias("spans"))
        out.append(fact.alias(report))
    return work.select(*out)


def line_digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, n_lines, n_removed, n_spans, and kept_sha256 of the kept text (null text: as empty)."""
    plain = df.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    done = dedup_lines(plain, key, text, "__fact")
    return done.select(
        key, F.col("__fact.lines").alias("n_lines"), F.col("__fact.removed").alias("n_removed"), F.col("__fact.spans").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256")
    )
