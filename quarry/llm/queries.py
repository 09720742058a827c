"""The registered query of each operator: the operator with production parameters over its whole table, and the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import main_text

    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer()).drop("k")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("k")


def op4_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import edited_pairs

    return edited_pairs(table(spark, sf_dir, "documents")).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents")).drop("text")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extraction, op2_best_fit_packing, op3_mixing, op4_merkle_fingerprints, op5_quality_classifier, op6_language_id, op7_simhash, op8_nearest, op9_suffix_dedup, op10_substring_dedup)}


_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP10 = f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER o AS k, count(*) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, i, word, CASE WHEN c = 20 AND row_number() OVER (PARTITION BY k, c ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS later FROM g),
v AS (SELECT doc_id, i, word, max(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
s AS (SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM v GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s ON d.doc_id = s.doc_id"""


def _fingerprint_sql(text: str, name: str, source: str) -> str:
    """Tables {name}: doc_id, fp, marks of the texts of a table."""
    from .merkle import _RUN, _SPACE, _WORD, SECTION, SHORT

    return f"""{name}_p AS (SELECT doc_id, list_transform(string_split({text}, chr(10)), lambda p: {{'node': md5(p), 'told': array_to_string(list_concat(['P' || left(md5(p), 8)],
    list_transform(CASE WHEN len(regexp_extract_all(p, '{_WORD}')) < {SHORT} THEN regexp_extract_all(p, '{_WORD}') ELSE list_transform(regexp_extract_all(p, '{_RUN}'), lambda c: regexp_replace(c, '{_SPACE}+\\z', '')) END, lambda c: left(md5(c), 6))), ' ')}}) AS ps FROM {source}),
{name}_s AS (SELECT doc_id, list_transform(range(0, len(ps), {SECTION}), lambda i: {{'node': md5(array_to_string(list_transform(ps[i + 1:i + {SECTION}], lambda p: p.node), '')), 'told': array_to_string(list_transform(ps[i + 1:i + {SECTION}], lambda p: p.told), ' ')}}) AS ss FROM {name}_p),
{name} AS (SELECT doc_id, md5(array_to_string(list_transform(ss, lambda s: s.node), '')) || ' ' || array_to_string(list_transform(ss, lambda s: 'S' || left(s.node, 8) || ' ' || s.told), ' ') AS fp FROM {name}_s)"""


def _likeness_sql(a: str, b: str) -> str:
    marks = lambda x: f"list_distinct(list_filter(string_split({x}, ' '), lambda m: length(m) = 6))"
    most = f"greatest(len({marks(a)}), len({marks(b)}))"
    return f"CASE WHEN left({a}, 32) = left({b}, 32) THEN 1.0::DOUBLE WHEN {most} = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({marks(a)}, {marks(b)}))::DOUBLE / {most} END"


def _op4_sql() -> str:
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS after, coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM t),
e AS (SELECT doc_id, text, next_id, left(text, length(text) - length(text) // 4) || left(after, length(text) // 4) AS edited FROM n),
{_fingerprint_sql('text', 'f', 'e')},
{_fingerprint_sql('edited', 'g', 'e')}
SELECT e.doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, f.fp AS fingerprint, g.fp AS edited_fingerprint,
{_likeness_sql('f.fp', 'g.fp')} AS near_edited, {_likeness_sql('f.fp', 'x.fp')} AS near_next FROM e JOIN f ON e.doc_id = f.doc_id JOIN g ON e.doc_id = g.doc_id JOIN f AS x ON e.next_id = x.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The others have no SQL form (models, tokenizers, XXH64, byte strings); tests hold them against brute force."""
    return {"op4_merkle_fingerprints": _op4_sql(), "op10_substring_dedup": OP10}
