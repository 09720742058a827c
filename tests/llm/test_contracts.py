"""The registered queries themselves, over small tables on disk, against brute force of what their contracts ask."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from marked_pages import PAGES

import __spark_entry__ as entry

pytest.importorskip("public_tokenizers")


def _texts():
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefghijklmnopräé") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    word = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = word(95), word(160)
    texts = [word(120), None, "", "One", " \t\n", base, base, base.upper(), base + " end", passage + "\n" + word(40), word(30) + " " + passage + " " + word(20), word(4000) + "\n" + passage, "To " * 150, "x" * 950, "x" * 950 + "y", "!!! ??? 123", "\n\n" + word(30) + "\n" + word(25), "ÄÖ ü " * 50]
    texts += [" ".join(w if rng.random() > 0.004 else "changed" for w in base.split()) for _ in range(6)]
    return texts


DOCS = [(7 * i + 3, t, ["en", "de", None][i % 3], "s", 0, "clash") for i, t in enumerate(_texts())]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(6)
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string").repartition(3).write.parquet(f"{d}/documents.parquet")
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[300:340] = x[20]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(400, None), (420, [0.0] * 16), (440, [float("nan")] * 16)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(i, f"u{i}", h) for i, (h, _) in enumerate(PAGES)] + [(900, None, None)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


def _rows(spark, folder, name):
    return [r.asDict() for r in entry.queries()[name](spark, folder).collect()]


def test_op1(spark, folder):
    got = {r["page_id"]: r for r in _rows(spark, folder, "op1_html_extraction")}
    for i, (_, text) in enumerate([*PAGES]):
        assert (got[i]["url"], got[i]["text"], got[i]["n_chars"]) == (f"u{i}", text, len(text))
    assert (got[900]["url"], got[900]["text"], got[900]["n_chars"]) == (None, "", 0) and len(got) == len(PAGES) + 1


def test_op2(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, expected, got = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set(), _rows(spark, folder, "op2_best_fit_packing")
    for i, t, *_ in DOCS:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expected |= {(i, p, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(ids), 2048))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == expected and len(got) == len(expected)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= 2048
    assert len(by) == -(-sum(r["length"] for r in got) // 2048)


def test_op4(spark, folder):
    got = {r["doc_id"]: r for r in _rows(spark, folder, "op4_merkle_fingerprints")}
    order = [(i, t or "") for i, t, *_ in sorted(DOCS)]
    prints = {}
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]]):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"] and prints.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and (r["near_edited"] == 1) == (edited == t) and (r["near_next"] == 1) == (after == t)
        if len(t.split()) > 100 and len(set(t.split())) > 50:
            assert r["near_edited"] > 0.55, t
    assert len(set(prints.values())) == len(prints)


def test_op6(spark, folder):
    for r in _rows(spark, folder, "op6_language_id"):
        text = dict((i, t) for i, t, *_ in DOCS)[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text or ""))) and r["lang_pred"] in ("und", "en", "de")


def test_op7(spark, folder):
    def fingerprint(text):
        words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[j : j + 4]), 42) for j in range(max(1, len(words) - 3))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fp = {i: fingerprint(t) for i, t, *_ in DOCS}
    least = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 4 and least[b] < least[a]:
                    least[a], changed = least[b], True
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in _rows(spark, folder, "op7_simhash")} == {i: (f"{fp[i]:016x}", least[i]) for i in fp}
    assert len(set(least.values())) < len(fp) - 5


def test_op8(spark, folder):
    import pandas as pd

    table = {int(i): np.array(v, dtype=float) for i, v in pd.read_parquet(f"{folder}/embeddings.parquet").itertuples(index=False) if v is not None}
    table = {i: v for i, v in table.items() if np.isfinite(v).all() and v.any()}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in _rows(spark, folder, "op8_nearest")}
    queries, found = [i for i in table if i % 20 == 0], 0
    for q in queries:
        best = sorted(((-float(v @ table[q]), i) for i, v in table.items() if i != q))[:20]
        own = [got[q, n] for n in range(1, 21)]
        assert [s for _, s in own] == sorted((s for _, s in own), reverse=True) and len({i for i, _ in own}) == 20
        assert all(s == pytest.approx(float(table[i] @ table[q]), abs=1e-12) for i, s in own)
        found += len({i for i, _ in own} & {i for _, i in best})
    assert len(got) == 20 * len(queries) and found >= 0.99 * len(got)


def test_op9(spark, folder):
    texts = {i: (t or "").encode() for i, t, *_ in DOCS}
    count = {}
    for t in texts.values():
        for s in range(len(t) - 399):
            count[t[s : s + 400]] = count.get(t[s : s + 400], 0) + 1
    got = {r["doc_id"]: r for r in _rows(spark, folder, "op9_suffix_dedup")}
    total = 0
    for i, t in texts.items():
        gone = np.zeros(len(t) + 1, dtype=bool)
        for s in range(len(t) - 399):
            if count[t[s : s + 400]] > 1:
                gone[s : s + 400] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(gone.astype(int)) == -1).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        total += int(gone.sum())
    assert total > 3000


def test_op10(spark, folder):
    seen, got = set(), {r["doc_id"]: r for r in _rows(spark, folder, "op10_substring_dedup")}
    for i, t, *_ in sorted(DOCS, key=lambda r: r[0]):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            if (key := tuple(words[s : s + 20])) in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(words), sum(gone), hashlib.sha256(kept).hexdigest())


def test_sql_of_the_queries_has_their_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and {"op4_merkle_fingerprints", "op10_substring_dedup"} <= set(entry.oracle_sql())
