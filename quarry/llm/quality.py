"""Quality classifier: a weak-label model over heuristic labellers teaches a hashed linear scorer.

Every labeller votes bad (0), good (1) or abstains (2) on a whole text. Votes of all documents are counted by
pattern (3 ** labellers rows at most), and expectation-maximisation on those counts estimates each labeller's
accuracy per class and the share of good texts, without any labels. The posteriors then train a logistic scorer
over hashed word features, on a sample of at most `sample` documents (those whose key hashes lowest); it scores all texts.

Cases: null and wordless texts: every labeller abstains and the score is that of a text without features, which the prior
makes good; on texts of fewer than `MIN_WORDS` words the labellers of repetition abstain, the others leave out what any short
text has (capitals that start a word, punctuation, digits), and words weigh less in the score, so nothing clean is lost for being
short; repeated rows score alike; an empty table gives an empty result; other columns pass if named in `carry`.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, row_key, texts_of, words_of, written

SAMPLE, DIM, MIN_WORDS, THRESHOLD = 4000, 1 << 14, 8, 0.5
KNOWN = 200_000  # words that a task remembers; beyond that it forgets all and learns anew
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER, _SYMBOLS = bytes(range(65, 91)), bytes(x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in ".,;:'\"-()?")
_SHAPE = bytes(65 if 65 <= x <= 90 else 97 if 97 <= x <= 122 or x >= 128 else 48 if 48 <= x <= 57 else x for x in range(256))
_NEUTRAL = b"0123456789.,;:'\"-()?!"
LABELLERS = ("symbols", "capitals", "distinct words", "repeated neighbour", "top word", "letters", "long words", "repeated lines")


def measures(text: bytes, words: list[bytes]) -> tuple[float | None, ...]:
    """One share for each labeller; None: it abstains."""
    n, counts = len(words), Counter(words)
    solid = sum(map(len, words))
    letters = len(text) - len(text.translate(None, _LETTERS))
    if n < MIN_WORDS:
        capitals = sum(len(w) - 1 - len(w[1:].translate(None, _UPPER)) for w in words)
        told = solid - sum(len(w) - len(w.translate(None, _NEUTRAL)) for w in words)
        return ((len(text) - len(text.translate(None, _SYMBOLS))) / solid, capitals / max(1, letters), None, None, None, letters / told if told else 0.0, solid / n / 40, None)
    lines = [x for x in text.split(b"\n") if x]
    return (
        (len(text) - len(text.translate(None, _SYMBOLS))) / solid,
        (len(text) - len(text.translate(None, _UPPER))) / max(1, letters),
        len(counts) / n ** 0.85,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        counts.most_common(1)[0][1] / n,
        letters / solid,
        solid / n / 40,
        1 - len(set(lines)) / max(1, len(lines)),
    )


#: Bad beyond the first, good within the second, and between them no vote; the sign tells the side that is bad.
CUTS = ((+1, 0.10, 0.04), (+1, 0.40, 0.20), (-1, 0.40, 0.80), (+1, 0.20, 0.05), (+1, 0.30, 0.15), (-1, 0.75, 0.88), (+1, 0.60, 0.40), (+1, 0.50, 0.30))


def votes(m: tuple[float | None, ...] | None) -> int:
    """The pattern in base 3, the first labeller lowest; None (no words): all abstain."""
    out = 0
    for i in reversed(range(len(CUTS))):
        sign, bad, good = CUTS[i]
        v = 2 if m is None or m[i] is None else 0 if sign * (m[i] - bad) > 0 else 1 if sign * (m[i] - good) < 0 else 2
        out = out * 3 + v
    return out


def weak_label_model(patterns: dict[int, int], rounds: int = 200) -> tuple[float, np.ndarray, dict[int, float]]:
    """Share of good texts, P(vote | class) as [labeller, class, vote], and each pattern's posterior of good."""
    m = len(CUTS)
    keys = np.array(sorted(patterns), dtype=np.int64)
    n = np.array([patterns[int(k)] for k in keys], dtype=float)
    v = keys[:, None] // 3 ** np.arange(m)[None, :] % 3
    voted, bad = (v != 2).sum(1), (v == 0).sum(1)
    # one vote of bad weighs more than one of good: each labeller sees one kind of junk, and calls the others good
    good = np.where(voted == 0, 0.95, np.where(bad == 0, 0.98, np.where(bad >= 2, 0.02, 0.3)))
    for _ in range(rounds):
        share = float(np.clip((n * good).sum() / max(1.0, n.sum()), 0.01, 0.99))
        p = np.zeros((m, 2, 3))
        for c, w in ((0, n * (1 - good)), (1, n * good)):
            for k in range(3):
                p[:, c, k] = ((v == k) * w[:, None]).sum(0) + (0.5 if k == 2 else 0.1 if (k == 1) != bool(c) else 1.0)
        p[:, :, :2] /= p[:, :, :2].sum(2, keepdims=True)  # given that it votes: abstaining tells nothing
        p[:, :, 2] = 1
        p[:, 1, 0] = np.minimum(p[:, 1, 0], 0.25)  # no labeller is worse than chance on good texts
        p[:, 1, 1] = 1 - p[:, 1, 0]
        score = np.log(share / (1 - share)) + sum(np.log(p[i, 1, v[:, i]] / p[i, 0, v[:, i]]) for i in range(m))
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if np.abs(new - good).max(initial=0) < 1e-6:
            break
        good = new
    return share, p, {int(k): float(g) for k, g in zip(keys, good)}


def _hash(x: bytes) -> int:
    return xxhash.xxh32_intdigest(x) % DIM


def features(words: list[bytes], m: tuple[float | None, ...] | None, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: shares of words, word shapes and endings, and each labeller's measure in eighths."""
    if m is None:
        return np.zeros(0, np.int64), np.zeros(0)
    ids = np.frombuffer(b"".join([memo[w] for w in words]), dtype=np.uint32)
    at, n = np.unique(ids, return_counts=True)
    extra = np.array([_hash(b"m%d:%d" % (i, min(8, int(x * 8)))) for i, x in enumerate(m) if x is not None])
    return np.concatenate([at, extra]).astype(np.int64), np.concatenate([n / max(MIN_WORDS, len(words)), np.full(len(extra), 0.5)])


def word_features() -> Memo:
    def make(w: bytes) -> bytes:
        shape = w.translate(_SHAPE)
        short = shape.replace(b"aaaa", b"a").replace(b"aa", b"a").replace(b"AAAA", b"A").replace(b"AA", b"A")
        return np.array([_hash(b"w" + w), _hash(b"s" + short), _hash(b"e" + w[-3:])], dtype=np.uint32).tobytes()

    return Memo(make, KNOWN)


def _seen(text: bytes):
    words = words_of(text)
    return words, measures(text, words) if words else None


def train(rows: list, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Adam, over at most `SAMPLE` rows of (features, shares, target)."""
    at = np.concatenate([np.frombuffer(r["f"], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    x = np.concatenate([np.frombuffer(r["x"], np.float64) for r in rows]) if rows else np.zeros(0)
    y = np.array([r["y"] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r["f"]) // 8 for r in rows])
    w, bias, m1, m2 = np.zeros(DIM), 2.0, np.zeros(DIM + 1), np.zeros(DIM + 1)
    for t in range(1, rounds + 1 if len(rows) else 1):
        p = 1 / (1 + np.exp(-(bias + np.bincount(row, x * w[at], len(rows)))))
        e = (p - y) / len(rows)
        g = np.append(np.bincount(at, x * e[row], DIM) + 1e-6 * w, e.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """id, carried columns, text, quality_score (0 to 1), keep, weak_label (posterior of the votes)."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"c_{c}") for c in carry]).withColumn("k", row_key("id", "text"))

    def vote(batches):
        for b in batches:
            out = [votes(_seen(t)[1]) for t in texts_of(b)]
            yield pa.record_batch({"k": b.column(0), "pattern": pa.array(out, pa.int32())})

    voted = written(own.select("k", "text").mapInArrow(vote, "k long, pattern int"))
    share, _, good = weak_label_model({r["pattern"]: r["count"] for r in voted.groupBy("pattern").count().collect()})
    chosen = voted.orderBy(F.xxhash64("k"), "k").limit(sample).select("k").distinct()

    def featured(batches):
        memo = word_features()
        for b in batches:
            seen = [_seen(t) for t in texts_of(b)]
            fx = [features(w, m, memo) for w, m in seen]
            yield pa.record_batch({"k": b.column(0), "f": pa.array([f.tobytes() for f, _ in fx], pa.binary()), "x": pa.array([x.tobytes() for _, x in fx], pa.binary()),
                                   "y": pa.array([good.get(votes(m), share) for _, m in seen], pa.float64())})

    rows = own.select("k", "text").join(F.broadcast(chosen), "k", "left_semi").mapInArrow(featured, "k long, f binary, x binary, y double").dropDuplicates(["k"]).collect()
    rows.sort(key=lambda r: r["k"])  # the same order, and so the same model, whichever task is first
    model = spark.sparkContext.broadcast(train(rows))
    goods = spark.sparkContext.broadcast((share, good))

    def score(batches):
        w, bias = model.value
        base, known = goods.value
        memo = word_features()
        worth = Memo(lambda x: float(w[np.frombuffer(memo.make(x), np.uint32)].sum()), KNOWN)
        extra = Memo(lambda im: 0.5 * float(w[_hash(b"m%d:%d" % im)]))
        for b in batches:
            s, weak = [], []
            for t in texts_of(b):
                words, m = _seen(t)
                z = bias
                if m is not None:
                    z += sum([worth[x] for x in words]) / max(MIN_WORDS, len(words)) + sum(extra[i, min(8, int(x * 8))] for i, x in enumerate(m) if x is not None)
                s.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
                weak.append(known.get(votes(m), base))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array(weak, pa.float64())], names=[*b.schema.names, "quality_score", "weak_label"])

    out = own.drop("k").mapInArrow(score, T.StructType([*own.drop("k").schema.fields, T.StructField("quality_score", T.DoubleType()), T.StructField("weak_label", T.DoubleType())]))
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), *[F.col(f"c_{c}").alias(c) for c in carry],
                      "quality_score", (F.col("quality_score") >= threshold).alias("keep"), "weak_label")
