"""Operators read, hold and yield texts lot by lot, and workers give back what a task has taken."""

import random

import pyarrow as pa
import pytest

from quarry.llm import common, packing, substring_dedup


def test_lots_are_whole_and_bounded():
    texts = ["a" * 30, None, "é" * 40, "", "b" * 200, "c", None, "d" * 99]
    batch = pa.record_batch({"id": pa.array(range(len(texts) + 2)), "text": pa.array(["x" * 500, "y", *texts])}).slice(2)  # offsets that don't start at 0
    for limit in (1, 100, 10_000):
        found = list(common.lots(batch, limit))
        assert [x for _, _, lot in found for x in lot] == [(t or "").encode() for t in texts]
        assert [i for i, _, _ in found] == [0, *[j for _, j, _ in found[:-1]]] and found[-1][1] == len(texts)
        assert all(sum(map(len, lot)) <= limit or sum(map(bool, lot)) == 1 for _, _, lot in found)
    assert list(common.lots(batch.slice(0, 0), 100)) == []


def test_repeats_are_cut_in_lots_of_texts():
    texts = [" ".join(f"w{i}_{j}" for j in range(20_000)) if i % 4 else None for i in range(16)]
    starts = [[5, 9] if t and i % 3 == 0 else None for i, t in enumerate(texts)]
    batch = pa.record_batch({"id": pa.array(range(16)), "text": pa.array(texts), "starts": pa.array(starts, pa.list_(pa.int32()))})
    out = list(substring_dedup._cutter(20, ["id", "kept_text", "n_words", "n_removed"])(iter([batch])))
    assert max(b.nbytes for b in out) < 1_000_000 < batch.nbytes
    for row, t, s in zip(pa.Table.from_batches(out).to_pylist(), texts, starts, strict=True):
        words = (t or "").split()
        assert (row["kept_text"], row["n_words"], row["n_removed"]) == (" ".join(words[:5] + words[29:] if s else words), len(words), 24 if s else 0)


def test_pieces_come_in_lots_of_texts(spark, monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    rng, held = random.Random(3), []
    texts = [None if i % 9 == 4 else " ".join(f"{rng.choice(['Tree', 'ash', 'Öl', '42'])}{rng.choice(',. ')}" for _ in range(12_000)) for i in range(80)]
    frame = spark.createDataFrame([(1, "")], "doc_id long, text string")
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema: held.append(f))
    packing.pieces(frame, path)
    batch = pa.record_batch({"id": pa.array(range(80)), "text": pa.array(texts), "k": pa.array(range(80))})
    memo = packing.word_ids(path)
    most, encode = [], memo.encode
    monkeypatch.setattr(memo, "encode", lambda lot: (most.append(sum(map(len, lot))), encode(lot))[1])
    out = pa.Table.from_batches(held[0](iter([batch]))).to_pylist()
    assert len(most) > 1 and max(most) <= 2_000_000 and sum(most) == sum(len((t or "").encode()) for t in texts) > 4_000_000
    assert not memo.runs
    whole = [memo.tok.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    assert [(r["id"], r["piece"], r["start"], r["length"]) for r in out] == [(i, p, s, min(2048, len(w) - s)) for i, w in enumerate(whole) for p, s in enumerate(range(0, len(w), 2048))]
