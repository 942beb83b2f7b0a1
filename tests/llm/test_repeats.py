import hashlib
from collections import Counter

import numpy as np

from glossa.llm import kernels, op3_windows, op4_substrings, ranged
from llm_corpus import corpus, empty, sorted_rows, texts

COLUMNS3 = ["doc_id", "n_words", "n_removed", "kept_sha256"]
COLUMNS4 = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def _windows(rows, k=35):
    split = [(key, (t or "").encode().split()) for key, t in rows]
    seen = Counter(tuple(w[i:i + k]) for _, w in split for i in range(len(w) - k + 1))
    out = []
    for key, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i:i + k])] > 1:
                gone[i:i + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((key, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _earlier(rows, k=50):
    late = 1 << 63
    first = {}
    raw = [(late if key is None else key, key, (t or "").encode()) for key, t in rows]
    for order, _, t in raw:
        for i in range(len(t) - k + 1):
            s = t[i:i + k]
            first[s] = min(first.get(s, order), order)
    out = []
    for order, key, t in raw:
        gone = [False] * len(t)
        for i in range(len(t) - k + 1):
            if first[t[i:i + k]] < order:
                gone[i:i + k] = [True] * k
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((key, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeated_windows(spark, stored):
    got = op3_windows.remove_repeats(stored, with_text=True)
    assert sorted_rows(got, COLUMNS3) == _windows(texts())
    for r in got.collect():
        assert hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"]


def test_repeated_windows_with_a_crowded_sketch(spark, stored, monkeypatch):
    monkeypatch.setattr(op3_windows, "sketch_for", lambda *_, **__: ranged.Sketch(1, 10))
    monkeypatch.setattr(op3_windows, "CHUNK_WINDOWS", 3000)
    assert sorted_rows(op3_windows.remove_repeats(stored), COLUMNS3) == _windows(texts())


def test_repeated_windows_over_many_ranges(spark, stored, monkeypatch):
    monkeypatch.setattr(op3_windows, "RANGE_BITS", 10)
    monkeypatch.setattr(op3_windows, "CHUNK_WINDOWS", 3000)
    assert sorted_rows(op3_windows.remove_repeats(stored), COLUMNS3) == _windows(texts())


def test_earlier_substrings(spark, stored):
    got = op4_substrings.remove_earlier(stored, with_text=True)
    assert sorted_rows(got, COLUMNS4) == _earlier(texts())
    for r in got.collect():
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]


def test_earlier_substrings_in_small_batches(spark, stored, monkeypatch):
    monkeypatch.setattr(op4_substrings, "MAX_CELLS", 1 << 10)
    monkeypatch.setattr(op4_substrings, "BATCH_STRINGS", 2000)
    monkeypatch.setattr(op4_substrings, "RUN", 3)
    assert sorted_rows(op4_substrings.remove_earlier(stored), COLUMNS4) == _earlier(texts())


def test_empty_tables(spark):
    assert op3_windows.remove_repeats(empty(spark)).count() == 0
    assert op4_substrings.remove_earlier(empty(spark)).count() == 0


def test_one_partition(spark):
    one = corpus(spark, 1)
    assert sorted_rows(op4_substrings.remove_earlier(one), COLUMNS4) == _earlier(texts())


def test_windows_of_a_hot_anchor_are_spread(spark, tmp_path, monkeypatch):
    """A passage of many documents between words of their own, some of which
    two documents share: no slice gets more than a part of its strings."""
    passage = "the same sixty bytes and more stand in all of these pages, always"
    rows = [(i, f"head {i * 7919 % 1000:03d}{i % 500} {passage} tail {i % 700}") for i in range(3000)] + [(None, passage)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    seen = {}
    keep = op4_substrings.staged

    def staged(df, name):
        seen[name] = keep(df, name)
        return seen[name]

    monkeypatch.setattr(op4_substrings, "staged", staged)
    monkeypatch.setattr(op4_substrings, "HOT_STRINGS", 200, raising=False)
    monkeypatch.setattr(op4_substrings, "HOT_EVERY", 2, raising=False)
    got = op4_substrings.remove_earlier(spark.read.parquet(path))
    assert sorted_rows(got, COLUMNS4) == _earlier(rows)
    per = [r[0] for r in seen["owners"].groupBy("slice").sum("n").select("sum(n)").collect()]
    assert max(per) < 0.25 * sum(per)


def test_every_anchor_hot(spark, stored, monkeypatch):
    monkeypatch.setattr(op4_substrings, "HOT_STRINGS", 1, raising=False)
    monkeypatch.setattr(op4_substrings, "HOT_EVERY", 1, raising=False)
    assert sorted_rows(op4_substrings.remove_earlier(stored), COLUMNS4) == _earlier(texts())


def test_anchors_fill_all_slices():
    """The smallest hash of a window lies near zero; slices are equal parts of
    the whole range."""
    rng = np.random.default_rng(5)
    data = rng.integers(97, 123, 200_000).astype(np.uint8)
    pack = kernels.Pack(0, data, np.array([0, len(data)]))
    at, low, _ = op4_substrings._anchors(pack, kernels.byte_prefix(data), 50)
    first, _ = op4_substrings._runs(at, low, np.zeros(len(at), np.int64), op4_substrings.RUN)
    per = np.bincount((low[first] >> np.uint64(58)).astype(int), minlength=64)
    assert per.max() < 2 * per.mean() and per.min() > per.mean() / 2
    by_text = {}
    for i, h in zip(at.tolist(), low.tolist()):
        grams = [data[j:j + 16].tobytes() for j in range(i, i + 35)]
        by_text.setdefault(h, set(grams)).intersection_update(grams)
    assert all(by_text.values())                # windows of one anchor share its string
