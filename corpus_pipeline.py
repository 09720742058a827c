"""A corpus pipeline of five stages over `documents`: judge, drop near copies, cut repeats, mix, pack.

Every stage takes rows with nulls in any column, repeated rows and ids, texts of any length, and further columns, which it leaves out; an
empty table gives an empty result. What else each does in such cases stands with it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import row_key, table, written
from quarry.llm.mixing import mix
from quarry.llm.near_copies import near_copies
from quarry.llm.packing import pack
from quarry.llm.quality import classify
from quarry.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OTHERS = ("lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and wordless texts have nothing against them and stay; repeated rows share their fate."""
    return classify(docs, carry=OTHERS).where("keep").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays (null ids last); of repeated rows, one."""
    found = near_copies(docs)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")
    stay = found.groupBy("root").agg(F.min_by("k", first).alias("k"))
    kept = docs.select(*COLUMNS).withColumn("k", row_key("doc_id", "text")).join(stay.select("k"), "k", "left_semi")
    n, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    return (kept.dropDuplicates(["k"]) if n != ids else kept).select(*COLUMNS)  # no row repeats another where ids differ


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word windows that start earlier go; untouched documents keep their text as it is, and no row is lost: a null text stays null, one of which
    nothing is left is empty."""
    cut = substring_dedup(docs, carry=("text", "lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says; repeated rows have one rate. Documents without tokens have the rate of their posterior like others."""
    rates = mix(docs, table(spark, sf_dir, "labels")).groupBy("k").agg(F.first("copies").alias("copies"))
    rows = docs.select(*COLUMNS).withColumn("k", row_key("doc_id", "text")).join(rates, "k")
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences, one or more for each row, copies included; a null text is its end token alone."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable]] = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", cut_repeats),
    ("mixing to target weights", mixed),
    ("best-fit packing", packed),
]

ORACLE_SQL = None  # models, tokens and packing have no SQL form; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
