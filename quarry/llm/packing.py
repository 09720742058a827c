"""Best-fit packing: a configuration linear program over the length histogram, priced by knapsack.

Documents become token pieces of at most `capacity`. Their histogram has at most `capacity` entries, whatever the
corpus size, so the program is solved on the driver. Its constraints are the lengths, its columns the configurations (multisets of
lengths that fit a sequence). Multiplicative weights give every length a price that falls by `ETA` per share of it that is
covered; each round prices all open lengths by knapsack dynamic programs, over random classes of about `CLASS` lengths, so that
one round finds many columns. A column enters if it is tight in the best dual found (value 1 at the dual prices), by
`STEP` of the room its scarcest length leaves, in whole sequences, so rounding down loses nothing. What is left when no column
is tight any more, or below `REST` of all tokens, is placed by best fit, in bulk per length. The dual value is a lower bound
on the number of sequences, and is reported beside the plan. Pieces are then numbered within
their length (by hash bucket, so that a frequent length is spread), and each number has its place in the plan.

Cases: null text is empty and has the single end token; repeated rows are packed each; an empty table gives an
empty result; null ids are kept.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, lots, row_key, written

CAPACITY, END = 2048, 0
ETA, LARGE, CLASS, STEP, REST, SEED = 0.1, 1.0, 256, 0.75, 0.3, 7
CHUNK_BYTES = 2_000_000


class PlainIds:
    """Token ids of whole texts, for any tokenizer: (ids of all texts, number of ids of each)."""

    def __init__(self, tokenizer):
        self.tok = tokenizer

    def forget(self) -> None:
        """Nothing is learnt."""

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, dtype="<u4") for e in self.tok.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        return np.concatenate([*found, np.zeros(0, "<u4")]), np.array([len(x) for x in found], dtype=np.int64)


class WordIds:
    """The same for tokenizers of the kind `covers` tells, run by run: a text's ids are those of its runs without ASCII white space, joined.

    Each different run is learnt once a task (beyond `limit` runs all is forgotten, so memory stays flat). White space and case are
    folded by these tokenizers and no token spans a letter and the punctuation after it, so a run is looked up without either. Words
    of Latin letters go through `tiktoken` with the same merges, where a byte that they do not hold marks the word's end; all other runs
    through `tokenizers` itself. Every lot of words is compared with `tokenizers` on a sample, and any difference raises.
    """

    PUNCTUATION = b".,;:!?*$%#&"
    MARK, PROBE = b"\x01", 64

    def __init__(self, tokenizer, told: dict, limit: int = 600_000):
        import tiktoken

        self.tok, self.limit = tokenizer, limit
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printed)]
        of = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}  # the printed form of bytes in such files
        ranks: dict[bytes, int] = {}
        for token, i in told["model"]["vocab"].items():
            ends = token.endswith("</w>")
            if not token.startswith("<|"):
                ranks[bytes(of[c] for c in token.removesuffix("</w>")) + (self.MARK if ends else b"")] = i
        self.ends = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.ends[[i for t, i in ranks.items() if len(t) > 1 and t.endswith(self.MARK)]] = True
        self.fast = tiktoken.Encoding("words", pat_str="[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})
        self.forget()

    @staticmethod
    def covers(told: dict) -> bool:
        """Byte-level BPE with word ends that folds white space and case and splits runs of letters from all else."""
        model, normal, split = told["model"], told.get("normalizer") or {}, (told.get("pre_tokenizer") or {}).get("pretokenizers") or []
        steps = [(x.get("type"), x.get("content")) for x in normal.get("normalizers", [])]
        return (model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("continuing_subword_prefix") and not model.get("dropout")
                and steps == [("NFC", None), ("Replace", " "), ("Lowercase", None)] and [x.get("type") for x in split] == ["Split", "ByteLevel"]
                and split[0].get("pattern", {}).get("Regex", "").endswith("[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+") and not split[1].get("add_prefix_space") and not told.get("post_processor"))

    def forget(self) -> None:
        """What is learnt goes: at the end of a task, so that a worker does not hold it through the stages after."""
        self.runs: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _split(self, run: bytes) -> tuple[bytes, bytes]:
        low = run if b"<|" in run else run.lower()  # special tokens are told by case
        base = low.rstrip(self.PUNCTUATION)
        return (base, low[len(base) :]) if base and 97 <= base[-1] <= 122 else (low, b"")

    @staticmethod
    def _latin(text: str) -> bool:
        """Letters that have one lower case and are their own normal form."""
        return text.isalpha() and (text.isascii() or (max(text) < "\u0250" and "\u0130" not in text))

    def _encoded(self, new: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each, as bytes."""
        out = {b"": b""}
        texts = [(x, x.decode("utf-8", "replace")) for x in new]
        words = [(x, t.lower()) for x, t in texts if self._latin(t)]
        if words:
            ids = np.asarray(self.fast.encode_to_numpy("\x01".join(t for _, t in words) + "\x01"), dtype="<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            found = {x: raw[a:b] for (x, _), a, b in zip(words, [0, *cuts], cuts)}
            sample = words[:: max(1, len(words) // self.PROBE)]
            told = self.tok.encode_batch_fast([t for _, t in sample], add_special_tokens=False)
            if len(cuts) != len(words) or any(np.array(e.ids, "<u4").tobytes() != found[x] for (x, _), e in zip(sample, told)):
                raise RuntimeError("word by word encoding differs from the tokenizer")
            out.update(found)
        rest = [(x, t) for x, t in texts if x not in out]
        for (x, _), e in zip(rest, self.tok.encode_batch_fast([t for _, t in rest], add_special_tokens=False) if rest else []):
            out[x] = np.array(e.ids, dtype="<u4").tobytes()
        return out

    def _places(self, runs: list[bytes]) -> np.ndarray:
        """The number of each different run, learning those that are new."""
        missing = [w for w in runs if w not in self.runs]
        if len(self.runs) + len(missing) > self.limit:
            self.forget()
            missing = runs
        if missing:
            parts = [self._split(w) for w in missing]
            told = self._encoded(list({x for pair in parts for x in pair}))
            raw = [told[a] + told[b] for a, b in parts]
            lot, count = np.frombuffer(b"".join(raw), "<u4"), np.array([len(x) // 4 for x in raw], dtype=np.int64)
            while self.used + len(lot) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), "<u4")])
            self.ids[self.used : self.used + len(lot)] = lot
            at = len(self.runs)
            self.runs.update(zip(missing, range(at, at + len(missing))))
            self.first = np.concatenate([self.first, self.used + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.used += len(lot)
        return np.array([self.runs[w] for w in runs], dtype=np.int64)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        try:
            column = pa.array(texts, pa.binary()).cast(pa.string())
        except pa.ArrowInvalid:  # not UTF-8
            column = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
        if not any(b"<|" in t for t in texts):
            column = pc.ascii_lower(column)
        split = pc.ascii_split_whitespace(column)
        runs = split.flatten().dictionary_encode()
        place = self._places([x.encode() for x in runs.dictionary.to_pylist()])[runs.indices.to_numpy(zero_copy_only=False)] if len(runs) else np.zeros(0, np.int64)
        count, bounds = self.count[place], split.offsets.to_numpy().astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(self.first[place] - upto[:-1], count) + np.arange(upto[-1])
        return self.ids[at], np.diff(upto[bounds - bounds[0]])


_LEARNT: dict[str, PlainIds | WordIds] = {}


def word_ids(tokenizer_path: str) -> PlainIds | WordIds:
    """One for each Python worker, as loading takes time."""
    if tokenizer_path not in _LEARNT:
        from tokenizers import Tokenizer

        with open(tokenizer_path, encoding="utf-8") as f:
            text = f.read()
        told, tokenizer = json.loads(text), Tokenizer.from_str(text)
        _LEARNT[tokenizer_path] = WordIds(tokenizer, told) if WordIds.covers(told) else PlainIds(tokenizer)
    return _LEARNT[tokenizer_path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, k, piece, start, length, ids_crc32) of every document, the end token included."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("k", row_key("id", "text"))

    def cut(batches):
        memo = word_ids(tokenizer_path)
        for b in batches:
            for first, _, texts in lots(b, CHUNK_BYTES):
                row, piece, start, length, crc = [], [], [], [], []
                ids, count = memo.encode(texts)
                ends = np.cumsum(count)
                whole = np.insert(ids, ends, END).astype("<u4").tobytes()
                at = 0
                for i, n in enumerate((count + 1).tolist(), first):
                    for p, s in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - s)
                        row.append(i)
                        piece.append(p)
                        start.append(s)
                        length.append(size)
                        crc.append(zlib.crc32(whole[4 * (at + s) : 4 * (at + s + size)]))
                    at += n
                take = pa.array(row, pa.int64())
                yield pa.record_batch({"id": b.column(0).take(take), "k": b.column(2).take(take), "piece": pa.array(piece, pa.int32()),
                                       "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})
        memo.forget()
        give_back()

    return own.mapInArrow(cut, T.StructType([own.schema["id"], T.StructField("k", T.LongType()), T.StructField("piece", T.IntegerType()),
                                             T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]))


def price(lengths: np.ndarray, values: np.ndarray, bounds: np.ndarray, capacity: int) -> tuple[dict[int, int], float]:
    """Bounded knapsack by dynamic programming: the multiset of lengths within capacity of the largest total value, and that value."""
    items = []
    for l, v, b in zip(lengths.tolist(), values.tolist(), bounds.tolist()):
        b, q = min(b, capacity // l), 1
        while b > 0:
            q = min(q, b)
            items.append((l, q, v * q))
            b, q = b - q, q * 2
    best, taken = np.zeros(capacity + 1), np.zeros((len(items), capacity + 1), dtype=bool)
    for i, (l, q, v) in enumerate(items):
        w = l * q
        with_it = best[: capacity + 1 - w] + v
        np.greater(with_it, best[w:] + 1e-12, out=taken[i, w:])
        np.copyto(best[w:], with_it, where=taken[i, w:])
    out, room = {}, capacity
    for i in range(len(items) - 1, -1, -1):
        l, q, _ = items[i]
        if room >= l * q and taken[i, room]:
            out[l] = out.get(l, 0) + q
            room -= l * q
    return out, float(best[capacity])


def configurations(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], float]:
    """Columns of the program with how often each is used, in whole sequences and never beyond the histogram; and the dual bound."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    n = np.array([histogram[int(l)] for l in lengths], dtype=float)
    covered, rng, place = np.zeros(len(lengths)), np.random.default_rng(SEED), {int(l): i for i, l in enumerate(lengths)}
    dual, bound = lengths / capacity, 0.0
    # any prices, divided by the best configuration's value, are dual feasible; three plain ones are tried first
    for prices in (lengths / capacity, 1.0 / (capacity // lengths), (2 * lengths > capacity) + 1e-9) if len(lengths) else ():
        _, value = price(lengths, prices, np.full(len(lengths), capacity), capacity)
        if (n * prices).sum() / value > bound * (1 + 1e-9):
            dual, bound = prices / value, float((n * prices).sum() / value)
    found: list[tuple[dict[int, int], int]] = []
    tokens, idle = float((lengths * n).sum()), 0
    while idle < 2 and ((n - covered) * lengths).sum() > REST * tokens:
        open_ = np.flatnonzero(n - covered >= 1)
        weight = np.exp(-ETA * covered / n)
        value = dual * weight * (1 + LARGE * lengths / capacity)  # of tight columns those of few long pieces first: short ones fit later
        idle += 1
        for part in np.array_split(rng.permutation(open_), max(1, len(open_) // CLASS)):
            part = np.sort(part)
            config, _ = price(lengths[part], value[part], (n - covered)[part].astype(np.int64), capacity)
            at = np.array([place[l] for l in config], dtype=np.int64)
            a = np.array(list(config.values()), dtype=float)
            if not len(a) or (dual[at] * a).sum() < 1 - 1e-6:
                continue
            x = max(1, int(STEP * ((n[at] - covered[at]) / a).min()))
            covered[at] += a * x
            found.append((config, x))
            idle = 0
    return found, bound


def completed(histogram: dict[int, int], plan: list[tuple[dict[int, int], int]], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """The plan and, for what it leaves of the histogram, best fit in bulk, longest first."""
    left = dict(histogram)
    for config, m in plan:
        for l, a in config.items():
            left[l] -= a * m
    # sequences with room: room -> list of [configuration, how many]
    rooms: dict[int, list] = {}
    for config, m in plan:
        rooms.setdefault(capacity - sum(l * a for l, a in config.items()), []).append((config, m))
    for l in sorted((l for l, c in left.items() if c > 0), reverse=True):
        m = left[l]
        while m:
            room = min((r for r in rooms if r >= l and rooms[r]), default=None)
            config, bins = rooms[room].pop() if room is not None else ({}, m)
            room = capacity if room is None else room
            q = min(room // l, m)
            use = min(bins, m // q)
            if use < bins and config:
                rooms.setdefault(room, []).append((config, bins - use))
            rooms.setdefault(room - q * l, []).append((config | {l: config.get(l, 0) + q}, use))
            m -= use * q
    return [x for group in rooms.values() for x in group]


def runs(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first number, sequence base, pieces a sequence, offset), in order of length and number."""
    out, cursor, base = [], {}, 0
    for config, m in plan:
        offset = 0
        for l, a in config.items():
            out.append((l, cursor.get(l, 0), base, a, offset))
            cursor[l] = cursor.get(l, 0) + m * a
            offset += l * a
        base += m
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, k, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer_path, id_col, text_col, capacity))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # `capacity` rows at most
    total = sum(histogram.values())
    columns, _ = configurations(histogram, capacity)
    plan = completed(histogram, columns, capacity)
    placed = spark.sparkContext.broadcast(runs(plan))

    buckets = max(64, total // 1_000_000)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("k", "piece", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = dealt.groupBy("length", "bucket").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within: Column = F.row_number().over(W.partitionBy("length", "bucket").orderBy("k", "piece"))
    numbered = dealt.withColumn("nth", within.cast("long") - 1).join(base, ["length", "bucket"])
    numbered = numbered.select("id", "k", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("base")).alias("nth"))

    def place(batches):
        table = placed.value
        key = table[:, 0] << 44 | table[:, 1]
        for b in batches:
            length, nth = b.column(4).to_numpy(), b.column(6).to_numpy()
            run = table[np.searchsorted(key, length << 44 | nth, side="right") - 1] if len(table) else np.zeros((0, 5), np.int64)
            i = nth - run[:, 1]
            yield pa.record_batch([*b.columns[:6], pa.array(run[:, 2] + i // run[:, 3]), pa.array(run[:, 4] + i % run[:, 3] * length)],
                                  names=["id", "k", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = numbered.mapInArrow(place, T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    return out.withColumnRenamed("id", id_col)
