import random

import numpy as np

import corpus_pipeline as p
from quarry.llm import near_copies
from quarry.llm.common import row_key


def test_stages(spark, tmp_path):
    rows = [(i, " ".join(chr(97 + (i * 37 + j * j) % 23) + "abcdefghijk"[(i + j * j // 23) % 7 : 3 + (i * j) % 8] + chr(97 + i * j % 19) for j in range(60 + i)), "en", "s", 0) for i in range(40)]
    rows += [(100, rows[3][1], "en", "s", 0), (101, "!!*** " * 40, "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, d = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    judged = p.quality(spark, docs, d).cache()
    kept = p.near_dedup(spark, judged, d).cache()
    assert set(kept.columns) == set(p.COLUMNS) and {r["doc_id"] for r in kept.collect()} == set(range(40))
    cut = p.cut_repeats(spark, kept, d).cache()
    assert cut.count() == 40
    mixed = p.mixed(spark, cut, d)
    assert mixed.count() == 40 and mixed.select(row_key("doc_id", "text")).distinct().count() == 40
    out = p.packed(spark, mixed, d)
    assert {r["doc_id"] for r in out.collect()} == set(range(40))
    assert [n for n, _ in p.STAGES][0] == "quality classifier" and p.run(spark, d).count() == out.count()


def _text(seed, n=80):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_near_dedup_keeps_one_of_each_group(spark):
    """Groups are told apart where ids are null or repeat."""
    rows = [(None, _text(1)), (None, _text(2)), (None, _text(3)), (1, _text(4)), (1, _text(5)), (2, _text(5)), (2, _text(5)), (3, _text(1))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in p.near_dedup(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(None, _text(2)), (None, _text(3)), (1, _text(4)), (1, _text(5)), (3, _text(1))], key=str)


def _set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_near_dedup_finds_every_pair_of_similarity(spark):
    """Of pairs from 0.4 to 1, those of five-word similarity 0.8 or more lose one, the others none."""
    rows, near = [], set()
    for i in range(240):
        words = _text(i, 150).split()
        rng = random.Random(-i)
        for _ in range(1 + i % 12):
            words[rng.randrange(len(words))] = "new%d" % rng.randrange(10**6)
        a, b = _text(i, 150), " ".join(words)
        rows += [(2 * i, a, "en", "s", 0), (2 * i + 1, b, "en", "s", 0)]
        near |= {2 * i + 1} if 5 * len(_set(a) & _set(b)) >= 4 * len(_set(a) | _set(b)) else set()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = {r["doc_id"] for r in p.near_dedup(spark, docs, "").collect()}
    assert 40 < len(near) < 200 and kept == set(range(480)) - near


def test_linked_is_all_pairs():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 1 << 63, 60).astype(np.uint64) for _ in range(6)]
    sets = []
    for i in range(120):
        x = base[i % 6].copy()
        x[rng.choice(60, i % 17, replace=False)] = rng.integers(0, 1 << 63, i % 17)
        sets.append(np.unique(x[: 60 - i % 5]))
    parent = list(range(120))
    for a in range(120):
        for b in range(a):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            if 5 * len(x & y) >= 4 * len(x | y):
                old, new = parent[a], parent[b]
                parent = [new if g == old else g for g in parent]
    got = near_copies.linked(sets)
    assert len(set(got)) == len(set(parent)) == len(set(zip(got, parent))) and 6 < len(set(got)) < 120


def test_each_stage_by_brute_force(spark, tmp_path):
    """Every stage on what the one before it kept: nulls, empty texts, repeated rows, near copies, shared passages and junk."""
    import zlib
    from collections import Counter

    import public_tokenizers
    from tokenizers import Tokenizer

    from quarry.llm.mixing import mix

    passage = _text(999, 45)
    texts = [_text(i, 120) for i in range(30)] + [_text(40 + i, 30) + " " + passage + " " + _text(60 + i, 30) for i in range(6)]
    texts += [t[:-5] + " end" for t in texts[:5]] + [None, "", "  ", "One.", texts[2], texts[2].upper()] + ["!!*** $$$ " * 30 + str(i) for i in range(4)]
    rows = [(3 * i + 1, t, "en" if i % 4 else None, "s", 0, "more") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, _text(77, 50), None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int("!!" not in (r[1] or "")), int(i % 9 == 0)) for i, r in enumerate(rows) if r[0] and i % 2], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    told = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    judged = p.quality(spark, spark.read.parquet(f"{d}/documents.parquet"), d).cache()
    assert told(judged) == sorted(((r[0], r[1]) for r in rows if "!!" not in (r[1] or "")), key=str)

    kept = p.near_dedup(spark, judged, d).cache()
    own = sorted({(r["doc_id"], r["text"] or "") for r in judged.collect()}, key=lambda r: (r[0] is None, r[0] or 0))
    sets = [_set(t) if t.split() else set() for _, t in own]
    group = list(range(len(own)))
    for a in range(len(own)):
        for b in range(a):
            if sets[a] == sets[b] or sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    assert [(i, t or "") for i, t in told(kept)] == sorted((own[g] for g in set(group)), key=str) and len(set(group)) < len(own) - 5

    cut = p.cut_repeats(spark, kept, d).cache()
    seen, expected = set(), []
    for i, t in sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=lambda r: (r[0] is None, r[0] or 0)):
        words = (t or "").split()
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            if (key := tuple(words[s : s + 20])) in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        expected.append((i, " ".join(w for w, g in zip(words, gone) if not g) if any(gone) else t))
    assert told(cut) == sorted(expected, key=str) and expected != told(kept)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in cut.collect())

    mixed = p.mixed(spark, cut, d).cache()
    rates = {(r["doc_id"], r["k"]): r for r in mix(cut, spark.read.parquet(f"{d}/labels.parquet")).collect()}
    copies = Counter(told(mixed))
    keyed = {(r["doc_id"], r["k"]): (r["doc_id"], r["text"]) for r in cut.select("doc_id", "text", row_key("doc_id", "text").alias("k")).collect()}
    assert set(keyed) == set(rates) and all(copies[row] == rates[k]["copies"] and abs(rates[k]["copies"] - rates[k]["rate"]) < 1 for k, row in keyed.items())

    packed = p.packed(spark, mixed, d).collect()
    tok, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for (i, t), n in copies.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for at, s in enumerate(range(0, len(ids), 2048)):
            pieces[i, at, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == pieces
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all([o for o, _ in sorted(x)] == [0, *np.cumsum([n for _, n in sorted(x)])[:-1]] and sum(n for _, n in x) <= 2048 for x in by.values())
    assert len(by) == -(-sum(r["length"] for r in packed) // 2048)
