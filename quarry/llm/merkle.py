"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame operations only.

A paragraph is a line, a section is a run of `SECTION` paragraphs. A paragraph's node is the MD5 of its bytes, a
section's node the MD5 of its paragraphs' nodes, and the root the MD5 of the sections' nodes. A paragraph's leaves are runs of
words that end where a word ends in one of `ENDINGS`, after `LONGEST` words at the latest, so what is inserted moves no later leaf; in
paragraphs of fewer than `SHORT` words every word is a leaf. As a string, parts are joined by spaces: the root (32
digits), then S and 8 digits for each section, before P and 8 digits for each of its paragraphs, before 6 digits of the MD5 of each leaf.

Cases: null text is empty; empty text has the tree of one empty paragraph and no leaves; equal texts have equal
fingerprints. "Next" goes by ascending id, null ids last, rows of one id by a hash of the text, and from the last row to the
first; a repeated row is the next of its like. If all ids are null the last row has no next: its next text is empty.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import row_key

SECTION, SHORT, LONGEST, ENDINGS = 8, 12, 8, "nst."
_SPACE, _WORD = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]+"
_RUN = f"(?:{_WORD}{_SPACE}+){{0,{LONGEST - 1}}}?[^\\x20\\x09-\\x0D]*[{ENDINGS}](?:{_SPACE}+|\\z)|(?:{_WORD}{_SPACE}*){{1,{LONGEST}}}"
ROWS_PER_BUCKET, MOST_BUCKETS = 2000, 4096


def _node(x: Column) -> Column:
    return F.md5(x.cast("binary"))


def _leaves(paragraph: Column) -> Column:
    words, runs = F.regexp_extract_all(paragraph, F.lit(_WORD), F.lit(0)), F.regexp_extract_all(paragraph, F.lit(_RUN), F.lit(0))
    chunks = F.when(F.regexp_count(paragraph, F.lit(_WORD)) < SHORT, words).otherwise(F.transform(runs, lambda c: F.regexp_replace(c, f"{_SPACE}+\\z", "")))
    return F.transform(chunks, lambda c: F.left(_node(c), F.lit(6)))


def _let(value: Column, body) -> Column:
    """body of the value, which is computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fingerprint(text: Column) -> Column:
    split = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    paragraphs = F.transform(split, lambda p: F.struct(_node(p).alias("node"), _leaves(p).alias("leaves")))

    def told(section: Column) -> Column:
        node = _node(F.array_join(F.transform(section, lambda p: p["node"]), ""))
        below = F.transform(section, lambda p: F.concat_ws(" ", F.concat(F.lit("P"), F.left(p["node"], F.lit(8))), p["leaves"]))
        return F.struct(node.alias("node"), F.concat_ws(" ", F.concat(F.lit("S"), F.left(node, F.lit(8))), below).alias("told"))

    def sections(ps: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(ps), F.lit(SECTION))
        return F.transform(F.transform(starts, lambda i: F.slice(ps, i, SECTION)), told)

    def whole(ss: Column) -> Column:
        return F.concat_ws(" ", _node(F.array_join(F.transform(ss, lambda s: s["node"]), "")), F.transform(ss, lambda s: s["told"]))

    return _let(_let(paragraphs, sections), whole)


def root(fp: Column) -> Column:
    """Equal for equal texts."""
    return F.left(fp, F.lit(32))


def _marks(fp: Column) -> Column:
    return F.filter(F.split(fp, " "), lambda x: F.length(x) == 6)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else the share of leaf marks in common, of the fingerprint that has more."""
    x, y = F.array_distinct(_marks(a)), F.array_distinct(_marks(b))
    most = F.greatest(F.size(x), F.size(y))
    return F.when(root(a) == root(b), 1.0).otherwise(F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), most), F.lit(0.0)))


def differing(a: Column, b: Column) -> Column:
    """Numbers, from 0, of the paragraphs of a that b does not have: equal roots are not looked into, and of the others only paragraphs whose
    node is nowhere among b's are named, so an inserted paragraph marks no later one."""
    def nodes(fp: Column) -> Column:
        return F.filter(F.split(fp, " "), lambda x: x.startswith("P"))

    def missing(theirs: Column) -> Column:
        told = F.transform(nodes(a), lambda x, i: F.when(~F.array_contains(theirs, x), i))
        return F.filter(told, lambda i: i.isNotNull())

    return F.when(root(a) == root(b), F.array().cast("array<int>")).otherwise(_let(nodes(b), missing))


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<column> of the row that follows by (id, k). One shuffle: rows are bucketed by quantiles of the id, and the
    first rows of every bucket are also sent to the bucket before, so no bucket needs another and none is global."""
    n = rows.count()
    buckets = max(1, min(MOST_BUCKETS, n // ROWS_PER_BUCKET))
    points = F.array(*[F.lit(i / buckets) for i in range(buckets)]) if buckets > 1 else F.array(F.lit(0.0))
    low, cuts = rows.agg(F.min("id"), F.percentile_approx("id", points, max(10_000, 10 * buckets))).first()
    cuts = sorted({low, *cuts}) if low is not None else []
    count = max(1, len(cuts))
    bounds = F.array(*[F.lit(c).cast(rows.schema["id"].dataType) for c in cuts])
    steps = [1 << i for i in reversed(range(count.bit_length()))]
    if len(cuts) > 1:
        at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, step: F.when(F.coalesce(F.get(bounds, lo + step) <= F.col("id"), F.lit(False)), lo + step).otherwise(lo))
        at = F.when(F.col("id").isNull(), F.lit(count - 1)).otherwise(at)
        first = F.coalesce(F.get(bounds, F.col("bucket")) == F.col("id"), F.lit(False))
    else:
        at, first = F.lit(0), F.coalesce(F.col("id") == F.lit(low), F.lit(False))
    home = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost"))
    before = F.struct(F.pmod(F.col("bucket") - 1, F.lit(count)).alias("b"), F.lit(1).alias("ghost"))
    dealt = rows.withColumn("bucket", at).withColumn("to", F.explode(F.when(first, F.array(home, before)).otherwise(F.array(home))))
    order = W.partitionBy("to.b").orderBy("to.ghost", F.col("id").asc_nulls_last(), "k")
    told = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return told.where("to.ghost = 0").drop("bucket", "to")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, fp) of every document."""
    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col), fingerprint(F.col(text_col)).alias("fp"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, edited, fingerprint, edited_fingerprint, near_edited, near_next)."""
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("k", row_key("id", "text"))
    rows = with_next(own.withColumn("fp", fingerprint(F.col("text"))), ["text", "fp"])
    n = F.length("text")
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.left("text", n - part), F.left(F.coalesce("next_text", F.lit("")), part))
    out = rows.select("id", "text", edited.alias("edited"), "fp", F.coalesce("next_fp", fingerprint(F.lit(""))).alias("next_fp"))
    out = out.withColumn("edited_fp", fingerprint(F.col("edited")))
    return out.select(F.col("id").alias(id_col), "text", "edited", F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"),
                      likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
