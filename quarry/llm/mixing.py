"""Mixing to target weights by soft membership, in DataFrame operations only.

A classifier learnt from the label table predicts how much each document belongs to each domain: naive Bayes with
Gaussians over character shares and presence of the words that tell the domains apart. Then nonnegative rates,
one a document, are fitted by projected-gradient least squares: each step sums rate * tokens * posterior by domain
over all documents (one small aggregate), compares it with the targets, and moves every rate against its
own share of the error, not below zero. Rates start at 1, so they stay as near to 1 as the targets allow. An error weighs by the inverse
of its domain's natural share, so rare domains move as fast as frequent ones and no step overshoots. Steps end when every domain is within `NEAR` of
its target, when `STALL` of them have not made the largest error a twentieth smaller (the targets cannot be met: posteriors overlap too much, or a
domain's rates are all zero), or after `STEPS`; a warning then tells the error left.

Domains are the labels' classes, `q<quality>t<toxic>`. Cases: null text has no tokens and rate 1 or its prior's; no labels,
or none that join: one domain, all rates 1; targets of domains that do not occur are dropped and the others
scaled; domains without a target keep their share; repeated rows get the same rate; labels given twice count twice; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import row_key, written

#: Shares of tokens after mixing. The label classes not named here keep their natural share.
TARGETS = {"q1t0": 0.96, "q0t0": 0.02, "q1t1": 0.02}
SAMPLE, LEXICON, STEPS, NEAR, STALL, NESTED, SALTS = 8000, 24, 60, 1e-4, 5, 8, 32
_SHARES = ("symbols", "capitals", "letters")


def _shape(text: Column) -> list[Column]:
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    return [
        F.regexp_count(text, F.lit("[!-+/:-@\\[-`{-~]")) / n,
        F.regexp_count(text, F.lit("[A-Z]")) / n,
        F.log1p(F.length(text).cast("double")) / 10,
    ]


def _words(text: Column) -> Column:
    """Runs of letters, lower-cased; other characters outside ASCII count as letters."""
    return F.split(F.lower(text), "[\\x00-@\\[-`{-\\x7F]+")


def fit_classifier(own: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Priors, Gaussians and word presences of each domain, from at most about `sample` labelled documents (lowest hashes)."""
    named = labels.where("doc_id is not null and quality is not null and toxic is not null").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("domain"))
    total = named.count()
    if not total:
        return None
    part = named.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / total)))
    joined = own.select("id", F.coalesce("text", F.lit("")).alias("text")).join(part, "id")
    rows = written(joined.select("domain", *[c.alias(n) for n, c in zip(_SHARES, _shape(F.col("text")))], F.array_distinct(_words(F.col("text"))).alias("words")))
    stats = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"a_{c}") for c in _SHARES], *[F.var_pop(c).alias(f"v_{c}") for c in _SHARES]).orderBy("domain").collect()
    if not stats:
        return None
    domains, size = [r["domain"] for r in stats], sum(r["n"] for r in stats)
    in_domain = rows.select("domain", F.explode("words").alias("w")).where("w <> ''").groupBy("w").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(f"d{i}") for i, d in enumerate(domains)])
    everywhere = sum(F.col(f"d{i}") for i in range(len(domains)))
    gain = [F.col(f"d{i}") * F.log2((F.col(f"d{i}") + 0.5) / float(r["n"] + 1) / ((everywhere - F.col(f"d{i}") + 0.5) / float(size - r["n"] + 1))) for i, r in enumerate(stats)]
    ranked = in_domain.where(everywhere >= max(5, size // 2000)).select("*", F.posexplode(F.array(*gain)).alias("domain", "gain")).where("gain > 0")
    # the best of each of SALTS parts of a domain's words first, so that no task ranks all of them
    nth = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("gain"), "w"))
    salted = ranked.withColumn("salt", F.pmod(F.xxhash64("w"), F.lit(SALTS))).withColumn("nth", nth("domain", "salt")).where(F.col("nth") <= LEXICON)
    top = salted.withColumn("nth", nth("domain")).where(F.col("nth") <= LEXICON).drop("nth", "salt", "domain", "gain").distinct().collect()
    return {
        "domains": domains, "n": [r["n"] for r in stats],
        "gauss": [[(r[f"a_{c}"], max(r[f"v_{c}"] or 0.0, 1e-4)) for c in _SHARES] for r in stats],
        "lexicon": {r["w"]: [(r[f"d{i}"] + 0.5) / (s["n"] + 1) for i, s in enumerate(stats)] for r in top},
    }


def _looked_up(odds: Column):
    return lambda w: F.element_at(odds, w)


def observed(model: dict) -> list[Column]:
    """What the posteriors look at, over columns text and words: tokens (runs of letters), the shares, and which words of the lexicon there are."""
    words = sorted(model["lexicon"])
    present = F.array_intersect("words", F.array(*[F.lit(w) for w in words])) if words else F.array().cast("array<string>")
    tokens = F.size("words") - F.when(F.element_at("words", 1) == "", 1).otherwise(0) - F.when((F.size("words") > 1) & (F.element_at("words", -1) == ""), 1).otherwise(0)
    return [tokens.cast("double").alias("tokens"), *[c.alias(n) for n, c in zip(_SHARES, _shape(F.col("text")))], present.alias("present")]


def posteriors(model: dict) -> list[Column]:
    """Expressions of each domain's log probability, up to a term in common, over the columns of observed()."""
    size, words = sum(model["n"]), sorted(model["lexicon"])
    logs = []
    for i, n in enumerate(model["n"]):
        z = F.lit(math.log(n / size) + sum(math.log1p(-min(0.999, model["lexicon"][w][i])) for w in words))
        for c, (mean, var) in zip(_SHARES, model["gauss"][i]):
            z = z - F.pow(F.col(c) - mean, 2) / (2 * var) - 0.5 * math.log(var)
        if words:
            seen = {w: min(0.999, model["lexicon"][w][i]) for w in words}
            odds = F.create_map(*[F.lit(x) for w in words for x in (w, math.log(seen[w]) - math.log1p(-seen[w]))])
            z = z + F.aggregate(F.transform("present", _looked_up(odds)), F.lit(0.0), lambda a, x: a + x)
        logs.append(z)
    return logs


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", steps: int = STEPS) -> DataFrame:
    """(id, k, tokens, domain, domain_p, posteriors, rate, copies): posteriors is a map by domain; copies is the rate rounded up or down, at odds by
    its fraction, by a hash of the row."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("k", row_key("id", "text"))
    model = fit_classifier(own, labels) or {"domains": ["all"], "n": [1], "gauss": [[(0.0, 1.0)] * len(_SHARES)], "lexicon": {}}
    names = model["domains"]
    # written first, so that every text is read once and not once a domain
    split = own.select("id", "k", F.coalesce("text", F.lit("")).alias("text")).withColumn("words", _words(F.col("text")))
    features = written(split.select("id", "k", *observed(model)))
    scored = features.select("id", "k", "tokens", F.array(*posteriors(model)).alias("z"))
    scored = scored.withColumn("e", F.transform("z", lambda x: F.exp(x - F.array_max("z")))).withColumn("s", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    told = written(scored.select("id", "k", "tokens", *[(F.col("e")[i] / F.col("s")).alias(f"p{i}") for i in range(len(names))]))

    def sums(rate: Column) -> list[float]:
        return [x or 0.0 for x in told.agg(*[F.sum(F.col("tokens") * rate * F.col(f"p{i}")) for i in range(len(names))]).first()]

    have = sums(F.lit(1.0))
    total = sum(have) or 1.0
    share = [x / total for x in have]
    asked = {names.index(d): w for d, w in (TARGETS if targets is None else targets).items() if d in names and share[names.index(d)] > 0}
    free = sum(s for i, s in enumerate(share) if i not in asked)
    scale = (1 - free) / sum(asked.values()) if sum(asked.values()) > 0 else 0.0
    want = [asked[i] * scale if i in asked else s for i, s in enumerate(share)]
    told, rate, far = told.withColumn("r", F.lit(1.0)), F.col("r"), [0.0]
    for step in range(1, steps + 1 if len(names) > 1 else 1):
        error = [s / total - w for s, w in zip(sums(rate), want)]
        far.append(max(map(abs, error)))
        if far[-1] < NEAR or step > STALL and far[-1] > 0.95 * far[-1 - STALL]:
            break
        move = sum(F.col(f"p{i}") * float(e / s) for i, (e, s) in enumerate(zip(error, share)) if s > 0)
        rate = F.greatest(F.lit(0.0), rate - move)
        if step % NESTED == 0:  # written, so that the expression does not grow with the steps
            told, rate = written(told.withColumn("r", rate)), F.col("r")
    if far[-1] >= NEAR:
        warnings.warn(f"mixing: a domain stays {far[-1]:.2g} of all tokens from its target", stacklevel=2)
    best = F.array_max(F.array(*[F.col(f"p{i}") for i in range(len(names))]))
    domain = F.coalesce(*[F.when(F.col(f"p{i}") == best, F.lit(n)) for i, n in enumerate(names)])
    u = F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    out = told.select("id", "k", "tokens", domain.alias("domain"), best.alias("domain_p"), F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.col(f"p{i}"))]).alias("posteriors"), rate.alias("rate"))
    return out.withColumn("copies", F.floor(F.col("rate") + u).cast("int")).withColumnRenamed("id", id_col)
