"""Operators 7 and 10."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from glossa.llm import op7_search, op10_toxicity
from llm_corpus import base_documents, edge_rows, empty, sorted_rows


def _words(t):
    return [w.lower() for w in (t or "").encode().split()]


def _bm25(docs, queries, k):
    tf = [Counter(_words(t)) for _, t in docs]
    size = [sum(c.values()) for c in tf]
    n, mean = len(docs), sum(size) / len(docs)
    df = Counter(w for c in tf for w in c)
    out = []
    for key, text in queries:
        scores = []
        for (doc, _), c, length in zip(docs, tf, size):
            s, any_ = 0.0, False
            for w in set(_words(text)):
                if c[w]:
                    any_ = True
                    s += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / mean))
            if any_:
                scores.append((-round(s, 7), math.inf if doc is None else doc))
        out += [(key, rank + 1, round(-s, 3)) for rank, (s, _) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def test_search_against_all_scores(spark, stored, monkeypatch):
    docs = [(r[0], r[1]) for r in base_documents() + edge_rows()]
    queries = [(key, t) for key, t in docs if key is not None and (key % 20 == 0 or key > 900000)]
    want = _bm25(docs, queries, 10)
    asked = stored.filter("doc_id % 20 = 0 or doc_id > 900000")
    for shard, block, first, qblock in ((1 << 25, 32, 16, 4096), (30_000, 4, 1, 7)):
        for name, value in (("SHARD_BYTES", shard), ("BLOCK", block), ("FIRST_BLOCKS", first), ("QUERY_BLOCK", qblock)):
            monkeypatch.setattr(op7_search, name, value)
        got = op7_search.bm25_search(stored, asked).collect()
        assert sorted(((r["query_id"], r["rank"], round(r["score"], 3)) for r in got), key=repr) == want


def test_pruning_skips_blocks_and_keeps_the_best():
    rng = np.random.default_rng(0)
    n = 4000
    doc = np.repeat(np.arange(n), 12)
    term = rng.zipf(1.3, len(doc)).clip(1, 500).astype(np.uint64)
    row = op7_search._shard(np.arange(n), doc, term, np.full(n, 12))
    shard = op7_search.Shard(row, 12.0)
    idf = {t: math.log(1 + n / f) for t, f in Counter(term.tolist()).items()}
    terms = np.array(sorted(idf), dtype=np.uint64)[::7]
    weights = np.array([idf[int(t)] for t in terms])
    ids, scores = shard.search(terms, weights, 10)
    full = np.zeros(n)
    for i, t in enumerate(shard.terms):
        if t in terms:
            a, b = shard.first[i], shard.first[i + 1]
            np.add.at(full, shard.ids[shard.docs[a:b]], idf[int(t)] * shard.worth[a:b])
    best = sorted(range(n), key=lambda d: (-round(full[d], 9), d))[:10]
    assert ids.tolist() == best and np.allclose(scores, full[best])


def test_a_block_of_queries_in_a_shard(monkeypatch):
    """Tiles, runs of blocks, dense columns and floors leave what all sums
    give, equal documents by id included."""
    rng = np.random.default_rng(1)
    n, names = 1500, np.unique(rng.integers(0, 1 << 63, 600).astype(np.uint64))
    rows = [np.clip(rng.zipf(1.25, rng.integers(0, 40)), 1, len(names)) - 1 for _ in range(n)]
    rows[300:700] = [rows[299]] * 400
    doc, size = np.repeat(np.arange(n), [len(r) for r in rows]), np.array([len(r) for r in rows])
    row = op7_search._shard(rng.permutation(n), doc, names[np.concatenate(rows)], size)
    shard = op7_search.Shard(row, size.mean())
    queries = [np.unique(r) for r in rows[280:340]] + [np.zeros(0, np.int64)]
    first, idf = np.append(0, np.cumsum([len(q) for q in queries])), rng.random(len(names)) + 0.01
    full = np.zeros((len(queries), n))
    for i, q in enumerate(queries):
        for w in q:
            at = np.searchsorted(shard.terms, names[w])
            a, b = shard.first[at], shard.first[at + 1]
            full[i, shard.docs[a:b]] += idf[w] * shard.worth[a:b]
    full = full.round(9)
    for patch in ({}, {"COMMON": 20, "TILE": 7, "GROUP": 2, "RUN": 3, "FEW": 5, "PAIRS": 50}, {"COMMON": 0, "FIRST_BLOCKS": 1}):
        for name, value in patch.items():
            monkeypatch.setattr(op7_search, name, value)
        for floor in (np.zeros(len(queries)), np.sort(full, axis=1)[:, -4]):
            found = op7_search.Asked(shard, names, idf).search(first, np.concatenate(queries).astype(np.int32), floor, 10)
            want = [(i, shard.ids[d], full[i, d]) for i in range(len(queries))
                    for d in np.lexsort((shard.ids, -full[i]))[:10] if full[i, d] > 0 and full[i, d] >= floor[i]]
            assert list(zip(*found)) == want


def test_a_small_rest_is_no_shard_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(op7_search, "SHARD_BYTES", 10_000)
    for rows, shards in ((280, [280]), (356, [100, 256]), (536, [256, 280])):
        docs = spark.range(rows).coalesce(1).selectExpr("id as doc_id", "lpad(id, 40, 'x') as text")
        built = op7_search.build_shards(docs)
        assert sorted(r[0] for r in built.select("n_docs").collect()) == shards
        assert len(built.inputFiles()) == len(shards)          # any number of tasks can read them


def test_order_when_upper_bits_do_not_tell_values_apart():
    rng = np.random.default_rng(2)
    for values in (rng.integers(0, 50, 1000), rng.integers(0, 1 << 63, 1000), np.zeros(0)):
        values = values.astype(np.uint64)
        order = op7_search._order(values)
        assert np.array_equal(np.sort(order), np.arange(len(values))) and np.array_equal(values[order], np.sort(values))


def test_search_of_nothing(spark, stored):
    assert op7_search.bm25_search(empty(spark), empty(spark)).count() == 0
    assert op7_search.bm25_search(stored, empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert op7_search.bm25_search(stored, blank).count() == 0


# --- 10 ----------------------------------------------------------------------

def _toxic_corpus(n=900):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghiklmnoprstu"), int(rng.integers(3, 8)))) for _ in range(400)]
    rows = []
    for i in range(n):
        w = [words[int(j)] for j in rng.integers(0, 400, int(rng.integers(30, 90)))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for bad in rng.choice(["zarkwit", "blorgface", "you zarkwit"], 4):
                w.insert(int(rng.integers(0, len(w))), str(bad))
        rows.append((i, " ".join(w), toxic))
    return rows


def test_held_out_accuracy_and_folds(spark):
    rows = _toxic_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    labels = df.filter("doc_id % 2 = 0 or toxic = 1").select("doc_id", "toxic")
    clash = df.select("doc_id", "text").withColumn("label", df["doc_id"]).withColumn("x", df["text"])
    out = {r["doc_id"]: r for r in op10_toxicity.toxicity(clash, labels).collect()}
    assert len(out) == len(rows)
    wrong = 0
    for key, _, toxic in rows:
        r = out[key]
        assert r["held_out"] == (zlib.crc32(str(key).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        wrong += r["held_out"] and r["predicted"] != toxic
    assert wrong <= 2


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = _toxic_corpus(400)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").coalesce(1)
    labels = df.select("doc_id", "toxic")
    flipped = labels.withColumn("toxic", op10_toxicity.F.when(op10_toxicity.held_out(labels["doc_id"]), 1 - labels["toxic"])
                                .otherwise(labels["toxic"]))
    a, b = (sorted_rows(op10_toxicity.toxicity(df, x), ["doc_id", "score"]) for x in (labels, flipped))
    assert a == b


def test_awkward_rows_and_missing_classes(spark, stored):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (900001, 0)], "doc_id long, toxic int")
    for some in (labels, labels.filter("toxic = 0"), labels.filter("toxic = 1"), labels.limit(0)):
        out = op10_toxicity.toxicity(stored, some)
        assert out.count() == stored.count()
        assert out.filter("score is null or score < 0 or score > 1 or held_out is null").count() == 0
    assert op10_toxicity.toxicity(empty(spark), labels).count() == 0


def test_features_see_disguise_and_second_person():
    import pyarrow as pa
    s = op10_toxicity.Scanner({"=idiot": 5.0, "^scumb": 3.0})
    at = {n: i for i, n in enumerate(op10_toxicity.FEATURES)}
    x = s.features(pa.array(["you are an IDIOT!", "an 1d1ot here", "scumbags and idiotic", None, "idiot " * 50 + "x " * 50, ""]))
    assert x[:, at["hits"]].tolist() == [1, 1, 1, 0, 50, 0]
    assert x[0, at["near_second_person"]] == 1 and x[1, at["disguised_hits"]] == 1
    assert x[0, at["exclamations"]] == 0.25 and x[0, at["capitals"]] > 0.3
    assert re.search("x", "x") and x[4, at["stretch_hits"]] == 50
