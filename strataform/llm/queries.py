"""The queries over the corpus operators, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_digests
from .common import fold, read_table
from .covertree import top_k_search
from .langid import language_predictions
from .line_dedup import line_digests
from .ogg import media_digests
from .packing import pack_documents
from .quality import quality_predictions
from .secret_scan import ACCESS, ACCESS_LEAST, ALLOWED, ASSIGN, ASSIGN_LEAST, CANDIDATE, CLASSES, HEX, KINDS, WINDOW, secret_digests
from .simhash import near_duplicates
from .suffix_dedup import repeat_digests


def _tokens(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, name) for name in ("documents", "labels"))
    return quality_predictions(docs, labels, fold("doc_id", 3) == 1)


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(read_table(spark, sf_dir, "documents"))


def op4_simhash_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(read_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(read_table(spark, sf_dir, "documents"), _tokens("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(read_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), _tokens("byte_bpe_50k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_predictions(read_table(spark, sf_dir, "documents"), fold("doc_id", 4) == 2)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_cover_tree, op2_quality_pu, op3_ogg_media, op4_simhash_bk, op5_suffix_dedup, op6_byte_bpe, op7_secret_scan, op8_best_fit_packing, op9_language_id, op10_line_dedup)
}
#: Inner products of the floored components, by brute force.
_TOP_K = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5"""
#: Windows of three lines, later ones by (doc_id, position), and the lines they cover.
_LINES = """
WITH d AS (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, array_to_string(ls[i + 1 : i + 3], chr(10)) AS win FROM (SELECT doc_id, ls, unnest(range(greatest(len(ls) - 2, 0))) AS i FROM d)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM later, (VALUES (0), (1), (2)) v(o)),
spans AS (SELECT doc_id, count(*) AS n_removed, sum(CASE WHEN p = i - 1 THEN 0 ELSE 1 END) AS n_spans FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM gone) GROUP BY 1),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM d),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, len(ls) AS n_lines, CAST(COALESCE(n_removed, 0) AS BIGINT) AS n_removed, CAST(COALESCE(n_spans, 0) AS BIGINT) AS n_spans, sha256(COALESCE(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _places(name: str, pattern: str, keep: str) -> str:
    """Spans of one kind: matches by regexp_extract_all, their places by the lengths of what lies between them."""
    rx = pattern.replace("'", "''")
    return f"""{name} AS (SELECT doc_id, {KINDS.index(name)} AS o, s, e, val FROM (
  SELECT doc_id, hit, val, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e, e - length(hit) AS s FROM (
    SELECT doc_id, unnest(regexp_extract_all(t, '{rx}')) AS hit, unnest(regexp_extract_all(t, '{rx}', {2 if name == "assign" else 0})) AS val,
      unnest(string_split_regex(t, '{rx}')[1:len(regexp_extract_all(t, '{rx}'))]) AS gap, generate_subscripts(regexp_extract_all(t, '{rx}'), 1) AS i FROM d)) WHERE {keep})"""


def _secrets_sql() -> str:
    found = [
        _places("assign", ASSIGN, f"length(val) >= {ASSIGN_LEAST}"),
        _places("access", ACCESS, f"length(val) >= {ACCESS_LEAST}"),
        _places("hex", HEX, "true"),
        _places("entropy", CANDIDATE, f"NOT regexp_full_match(val, '{ALLOWED.replace('^', '').replace('$', '')}')"),
    ]
    least = " ".join(f"WHEN regexp_full_match(val, '{rx[1:-1]}') THEN {bits}" for rx, bits in CLASSES.values())
    return f"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents), {", ".join(found)},
peak AS (SELECT doc_id, s, max(list_aggregate(string_split(substr(val, CAST(i + 1 AS BIGINT), {WINDOW}), ''), 'entropy')) AS bits
  FROM (SELECT doc_id, s, val, unnest(range(greatest(length(val) - {WINDOW - 1}, 1))) AS i FROM entropy) GROUP BY 1, 2),
odd AS (SELECT entropy.* FROM entropy JOIN peak USING (doc_id, s) WHERE bits >= CASE {least} END),
base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
every AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][o + 1] || ':' || s || ':' || e AS line FROM (SELECT * FROM base UNION ALL SELECT * FROM odd)),
said AS (SELECT doc_id, count(*) FILTER (o = 0) AS a, count(*) FILTER (o = 1) AS b, count(*) FILTER (o = 2) AS c, count(*) FILTER (o = 3) AS x, string_agg(line, ',' ORDER BY s, o) FILTER (o < 3) AS base, string_agg(line, ',' ORDER BY s, o) AS spans FROM every GROUP BY 1)
SELECT d.doc_id, COALESCE(a, 0) AS n_assign, COALESCE(b, 0) AS n_access, COALESCE(c, 0) AS n_hex, sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans, COALESCE(x, 0) AS n_entropy FROM d LEFT JOIN said USING (doc_id)"""


#: SQL where it can say the query: fingerprints, fitted models, tokenizers, containers, suffix arrays and packing it can't.
ORACLE_SQL: dict[str, str] = {"op1_cover_tree": _TOP_K, "op7_secret_scan": _secrets_sql(), "op10_line_dedup": _LINES}
