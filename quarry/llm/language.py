"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads the bytes of a text (ASCII letters lower-cased) in both directions and labels every byte; a document's probabilities are the means
of its bytes' probabilities. Texts of more than `CORE` bytes are read in stretches of that many, each with `OVERLAP` more bytes to
either side, over which the states run in without being pooled: what a state still knows after so many bytes is too little to matter. Stretches run
side by side, longest first, so that none is padded.

Training is by backpropagation through time on windows of `WINDOW` bytes, at most `WINDOWS` a document spread over its whole text, of about `DOCS`
documents with a language: those whose id hashes below a threshold, so that no text moves for the choice. Languages weigh alike.

Cases: null text, or one without a letter, is `und` with score 0; so is everything if there is nothing to learn from;
documents with a null language only get predictions; repeated rows get the same result (scores are rounded to six digits, as sums may
differ in the last); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_by_size, texts_of

DOCS, WINDOWS, WINDOW = 2500, 6, 64
HIDDEN, STEPS, BATCH = 8, 400, 128
CORE, OVERLAP, LANES = 512, 32, 2048
HELD_OUT = 2


def fold(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights of both directions: inputs by byte (with bias), recurrent matrices, and the output layer."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.w = {f"x{d}": rng.normal(0, 0.3, (256, 3 * hidden)) for d in "fb"} | {f"u{d}": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)) for d in "fb"}
        self.w |= {"v": rng.normal(0, 0.3, (2 * hidden, classes)), "c": np.zeros(classes)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States at every position; x is (batch, time)."""
        n, time, size = *x.shape, self.hidden
        h, out, u = np.zeros((n, size), np.float32), np.empty((n, time, size), np.float32), self.w[f"u{d}"]
        for t in range(time) if d == "f" else reversed(range(time)):
            a, b = self.w[f"x{d}"][x[:, t]], h @ u
            gates = _sigmoid(a[:, : 2 * size] + b[:, : 2 * size])
            z, r = gates[:, :size], gates[:, size:]
            new = np.tanh(a[:, 2 * size :] + r * b[:, 2 * size :])
            if keep is not None:
                keep.append((t, h, z, r, new, b[:, 2 * size :]))
            h = new + z * (h - new)
            out[:, t] = h
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of every position, (batch, time, classes)."""
        both = np.concatenate([self._run(x, "f"), self._run(x, "b")], axis=2)
        y = both @ self.w["v"] + self.w["c"]
        y -= y.max(axis=2, keepdims=True)
        return y - np.log(np.exp(y).sum(axis=2, keepdims=True))

    def gradients(self, x: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Cross entropy of every position against the window's target distribution, by backpropagation through time."""
        kept, size = {"f": [], "b": []}, self.hidden
        both = np.concatenate([self._run(x, d, kept[d]) for d in "fb"], axis=2)
        y = both @ self.w["v"] + self.w["c"]
        y -= y.max(axis=2, keepdims=True)
        p = np.exp(y)
        p /= p.sum(axis=2, keepdims=True)
        count = x.size
        loss = float(-(target[:, None] * np.log(p + 1e-9)).sum() / count)
        dy = (p - target[:, None]) / count
        g = {"v": np.einsum("nth,ntc->hc", both, dy), "c": dy.sum((0, 1))}
        back = dy @ self.w["v"].T
        for d, part in (("f", back[:, :, :size]), ("b", back[:, :, size:])):
            u, gx, gu, dh = self.w[f"u{d}"], np.zeros_like(self.w[f"x{d}"]), np.zeros_like(self.w[f"u{d}"]), np.zeros((len(x), size), np.float32)
            for t, h, z, r, new, bn in reversed(kept[d]):
                dh = dh + part[:, t]
                dnew = dh * (1 - z) * (1 - new * new)
                dz = dh * (h - new) * z * (1 - z)
                dr = dnew * bn * r * (1 - r)
                da = np.concatenate([dz, dr, dnew], axis=1)
                db = np.concatenate([dz, dr, dnew * r], axis=1)
                np.add.at(gx, x[:, t], da)
                gu += h.T @ db
                dh = dh * z + db @ u.T
            g |= {f"x{d}": gx, f"u{d}": gu}
        return loss, g


def train(x: np.ndarray, lang: np.ndarray, classes: int, steps: int = STEPS) -> Network:
    """x: windows of bytes; lang: the number of each one's language."""
    net, rng = Network(classes), np.random.default_rng(11)
    weight = 1.0 / np.bincount(lang, minlength=classes)[lang]
    target = np.eye(classes, dtype=np.float32)
    m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}
    for step in range(1, steps + 1):
        pick = rng.choice(len(x), BATCH, p=weight / weight.sum())
        _, g = net.gradients(x[pick], target[lang[pick]])
        lr = 0.02 * (1 - step / (steps + 1)) + 0.001
        for k, v in g.items():
            m[k][0] = 0.9 * m[k][0] + 0.1 * v
            m[k][1] = 0.99 * m[k][1] + 0.01 * v * v
            net.w[k] = (net.w[k] - lr * (m[k][0] / (1 - 0.9**step)) / (np.sqrt(m[k][1] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


class Reader:
    """The network with its arrays turned, features by lanes, and gates scaled for tanh: the same probabilities, faster."""

    def __init__(self, net: Network):
        size = net.hidden
        half = np.repeat(np.array([0.5, 0.5, 1.0], np.float32), size)  # sigmoid(x) = (1 + tanh(x / 2)) / 2
        self.size = size
        self.x = {d: np.ascontiguousarray(net.w[f"x{d}"] * half) for d in "fb"}
        self.u = {d: np.ascontiguousarray((net.w[f"u{d}"] * half).T) for d in "fb"}
        self.v = np.ascontiguousarray(net.w["v"].T)
        self.c = net.w["c"][:, None].astype(np.float32)
        self.steep = float((np.abs(self.v).sum(1) + np.abs(self.c[:, 0])).max()) > 80  # else exp cannot overflow

    def _step(self, d: str, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The states after one more byte in each lane."""
        size = self.size
        a, b = np.take(self.x[d], x, axis=0, mode="clip").T, self.u[d] @ h
        gates = b[: 2 * size]
        gates += a[: 2 * size]
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        new = b[2 * size :]
        new *= gates[size:]
        new += a[2 * size :]
        np.tanh(new, out=new)
        out = h - new
        out *= gates[:size]
        out += new
        return out

    def pooled(self, text: np.ndarray, first: np.ndarray, size: np.ndarray, lead: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Sums of the probabilities of text[first:first + size] but for `lead` bytes at the start and `tail` at the end, a row a stretch."""
        out = np.zeros((len(first), len(self.c)))
        order = np.argsort(-size, kind="stable")
        for i in range(0, len(order), LANES):
            own = order[i : i + LANES]
            at, n, skip, stop = first[own], size[own], lead[own], size[own] - tail[own]
            time = int(n[0])
            live = np.searchsorted(-n, -np.arange(time), side="left")  # lanes with a byte at this place
            states = np.zeros((time, self.size, len(own)), np.float32)
            h = np.zeros((self.size, len(own)), np.float32)
            for t in range(time):
                k = live[t]
                h = self._step("f", text[at[:k] + t], h[:, :k])
                states[t, :, :k] = h
            total = np.zeros((len(self.c), len(own)), np.float32)
            h = np.zeros((self.size, 0), np.float32)
            for t in reversed(range(time)):
                k = live[t]
                if h.shape[1] < k:
                    h = np.concatenate([h, np.zeros((self.size, k - h.shape[1]), np.float32)], axis=1)
                h = self._step("b", text[at[:k] + t], h)
                y = self.v[:, : self.size] @ states[t, :, :k]
                y += self.v[:, self.size :] @ h
                y += self.c
                if self.steep:
                    y -= y.max(0)
                np.exp(y, out=y)
                y *= ((skip[:k] <= t) & (t < stop[:k])) / y.sum(0)
                total[:, :k] += y
            out[own] = total.T
        return out

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities of each text, none of which is empty."""
        text = np.frombuffer(b"".join(texts).lower(), np.uint8)
        n = np.array([len(t) for t in texts])
        begin = np.cumsum(n) - n
        parts = -(-n // CORE)
        doc = np.repeat(np.arange(len(texts)), parts)
        core = begin[doc] + CORE * (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts))
        end = np.minimum(core + CORE, (begin + n)[doc])
        first, last = np.maximum(core - OVERLAP, begin[doc]), np.minimum(end + OVERLAP, (begin + n)[doc])
        sums = self.pooled(text, first, last - first, core - first, last - end)
        total = np.zeros((len(texts), sums.shape[1]))
        np.add.at(total, doc, sums)
        return total / n[:, None]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_at_most: int = DOCS) -> tuple[list[str], Network | None]:
    """Languages and a network, from a sample of about `docs_at_most` documents."""
    taught = docs.where((fold(id_col) != HELD_OUT) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = taught.count()
    below = F.pmod(F.xxhash64(id_col, F.lit(9)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, docs_at_most / max(1, n)))

    def windows(batches):
        for b in batches:
            lang, window = [], []
            for name, t in zip(b.column(0).to_pylist(), texts_of(b)):
                t = t.lower()
                count = min(WINDOWS, max(1, len(t) // WINDOW))
                if any(map(str.isalpha, t.decode("utf-8", "replace"))):
                    for i in range(count):
                        at = (len(t) - WINDOW) * i // max(1, count - 1) if count > 1 else 0
                        lang.append(name)
                        window.append(t[at : at + WINDOW].ljust(WINDOW))
            yield pa.record_batch({"lang": pa.array(lang, pa.string()), "w": pa.array(window, pa.binary())})

    rows = sorted((r["lang"], bytes(r["w"])) for r in taught.where(below).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(windows, "lang string, w binary").collect())
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return langs, None
    x = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(len(rows), WINDOW)
    return langs, train(x, np.array([langs.index(lang) for lang, _ in rows]), len(langs))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score)."""
    langs, net = learn(docs, id_col, text_col, lang_col)
    model = docs.sparkSession.sparkContext.broadcast(net)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (fold(id_col) == HELD_OUT).alias("held_out"))

    def predict(batches):
        reader = Reader(model.value) if langs else None
        for b in batches:
            texts = texts_of(b)
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            told = [i for i, t in enumerate(texts) if reader and any(map(str.isalpha, t.decode("utf-8", "replace")))]
            for first, last in rows_by_size([texts[i] for i in told], 4_000_000):
                for i, p in zip(told[first:last], reader.documents([texts[i] for i in told[first:last]])):
                    names[i], scores[i] = langs[int(p.argmax())], round(min(1.0, float(p.max())), 6)
            yield pa.record_batch({"id": b.column(0), "held_out": b.column(2), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    out = own.mapInArrow(predict, T.StructType([own.schema["id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return out.withColumnRenamed("id", id_col)
