"""Import and export: NDJSON, and JSON arrays."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from ..plans.find import project


#: Bad lines that are told one by one; all are counted.
LISTED = 1000


@dataclass
class ImportResult:
    total: int = 0
    inserted: int = 0
    skipped: int = 0
    errors: list[dict] = field(default_factory=list)


def format_of(path: str, given: str | None) -> str:
    if given:
        return given
    return "json" if path.endswith(".json") else "ndjson"


def read_lines(spark: SparkSession, path: str) -> tuple[DataFrame, list[dict], int]:
    """Documents of an NDJSON file; its first `LISTED` bad lines with their number among the lines that are not blank; and how many are bad.

    Two passes over the text, whatever the number of bad lines: lines are counted by partition, and a line's number is its place in its
    partition and the counts of those before."""
    raw = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").json(path)
    if "__bad" not in raw.columns:
        return raw, [], 0
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("id"), (F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{")).alias("bad"))
    parts = lines.groupBy(F.shiftright("id", 33).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")).orderBy("p").collect()
    before = dict(zip([r["p"] for r in parts], accumulate([0, *[r["n"] for r in parts]])))
    bad = lines.where("bad").select("id").orderBy("id").limit(LISTED).collect()
    errors = [{"line": before[r["id"] >> 33] + (r["id"] & (1 << 33) - 1) + 1, "error": "not a JSON object"} for r in bad]
    return raw.cache().where("__bad is null").drop("__bad"), errors, sum(r["bad"] for r in parts)


def read_array(spark: SparkSession, path: str) -> DataFrame:
    head = spark.read.text(path, wholetext=True).select(F.left(F.ltrim("value"), F.lit(1)).alias("c")).first()
    if head is None or head["c"] != "[":
        raise QueryError("a JSON import file holds an array")
    return spark.read.option("multiLine", True).json(path)


def export(df: DataFrame, path: str, format: str | None = None, projection: dict | None = None) -> int:
    """Documents written. NDJSON is written in parts by the executors; a JSON array is one file, written by the driver."""
    out = project(df, projection)
    if format_of(path, format) == "ndjson":
        out.write.mode("overwrite").option("ignoreNullFields", True).json(path)
        return out.count()
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for r in out.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in out.columns])).alias("j")).toLocalIterator():
            f.write(("," if n else "") + r["j"])
            n += 1
        f.write("]")
    return n


