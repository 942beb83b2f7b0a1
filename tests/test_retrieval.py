import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.operators import retrieval


def _vec_df(spark, ids, mat, id_col):
    return spark.createDataFrame([(int(i), [float(v) for v in m]) for i, m in zip(ids, mat)],
                                 f"{id_col} long, embedding array<float>")


@pytest.mark.parametrize("k,state_bytes", [(7, retrieval.DEFAULT_STATE_BYTES), (7, 4 * 8 * 40), (1000, 1 << 14)])
def test_topk_matches_brute_force(spark, k, state_bytes):
    rng = np.random.default_rng(0)
    d = rng.normal(size=(200, 4)).astype(np.float32)
    d[10] = d[11]                       # identical documents: tie by id
    q = d[:13]
    run = retrieval.score_topk(_vec_df(spark, range(13), q, "qid"),
                               _vec_df(spark, range(200), d, "doc_id"), k, state_bytes=state_bytes, work_bytes=2048)
    got = {}
    for r in run.collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["doc_id"]))
    dn = d.astype(float) / np.linalg.norm(d.astype(float), axis=1, keepdims=True)
    for i in range(13):
        s = np.round(dn @ dn[i], 12)
        want = sorted(range(200), key=lambda j: (-s[j], j))[:k]
        assert [doc for _, doc in sorted(got[i])] == want


def test_block_pairs_are_skipped_exactly(spark):
    """Clustered vectors in small blocks: far pairs are never opened, results
    equal brute force; a repeated id and zero vectors among them."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 6)) * 4
    d = (centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 6)) * 0.1).astype(np.float32)
    d[[7, 300]] = 0.0
    q = (centres[rng.integers(0, 12, 40)] + rng.normal(size=(40, 6)) * 0.1).astype(np.float32)
    q[3] = 0.0
    report = {}
    docs = _vec_df(spark, range(600), d, "doc_id").repartition(5)
    run = retrieval.score_topk(_vec_df(spark, range(40), q, "qid"), docs, 5, state_bytes=(6 + 20) * 8 * 4,
                               block_bytes=6 * 8 * 30, report=report)
    got = {}
    for r in run.collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["doc_id"]))
    unit = lambda m: m.astype(float) / np.maximum(np.linalg.norm(m.astype(float), axis=1, keepdims=True), 1e-12)
    s = np.round(unit(q) @ unit(d).T, 12)
    for i in range(40):
        assert [doc for _, doc in sorted(got[i])] == sorted(range(600), key=lambda j: (-s[i, j], j))[:5]
    assert report["pairs"] == report["first"] + report["second"] + report["skipped"]
    assert report["skipped"] > 0.4 * report["pairs"]
    # equal vectors everywhere: every bound is reached, nothing may be skipped
    same = _vec_df(spark, range(200), np.ones((200, 6)), "doc_id")
    again = retrieval.score_topk(_vec_df(spark, range(3), np.ones((3, 6)), "qid"), same, 4, block_bytes=6 * 8 * 20, report=report)
    assert sorted((r["qid"], r["doc_id"]) for r in again.collect()) == [(i, j) for i in range(3) for j in range(4)]
    assert report["skipped"] == 0


def test_blocks_are_bounded_on_both_sides(spark):
    from glossa.operators import blocks
    hot = spark.range(4000).selectExpr("7L as doc_id", "array(1D, 0D) as v", "id as _row")
    rows = blocks.blocked(blocks.placed(hot, np.array([[1.0, 0.0], [0.0, 1.0]]), 2), [], 100, "test")
    sizes = [r["dn"] for r in blocks.block_list(rows, [], "d").collect()]
    assert sum(sizes) == 4000 and max(sizes) < 160


def test_the_encoder_runs_once_per_text(spark, tmp_path):
    class Counting:
        """The default encoder, noting in a file how many texts it was given."""

        def __init__(self, path):
            self.path = path

        def __call__(self):
            from glossa.operators import encoder
            plain, path = encoder.HashedBagOfWords(8)(), self.path

            def encode(texts):
                with open(path, "a") as f:
                    f.write(f"{len(texts)}\n")
                return plain(texts)
            return encode

    from glossa.operators import encoder
    path = str(tmp_path / "calls")
    texts = spark.range(60).selectExpr("id as doc_id", "concat('t', id % 7, ' u', id) as text")
    vecs = encoder.encode_texts(texts, Counting(path), keep=("doc_id",))
    run = retrieval.score_topk(vecs.withColumnRenamed("doc_id", "qid"), vecs, 3, block_bytes=8 * 8 * 10)
    assert run.count() == 180
    assert sum(map(int, open(path))) == 120                        # each side once


def test_topk_string_ids_null_and_odd_vectors(spark):
    q = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", None)], "qid string, embedding array<double>")
    d = spark.createDataFrame([("12#3", [-1.0, 0.0]), ("a", [0.0, 1.0]), ("b", None), ("c", [1.0]), ("A", [0.0, 2.0])],
                              "doc_id string, embedding array<double>")
    got = [(r["qid"], r["rank"], r["doc_id"], r["score"]) for r in
           retrieval.score_topk(q, d, 10).orderBy("qid", "rank").collect()]
    assert got == [("q1", 1, "A", 0.0), ("q1", 2, "a", 0.0), ("q1", 3, "12#3", -1.0)]


def test_topk_without_queries(spark):
    none = spark.createDataFrame([], "qid long, embedding array<double>")
    d = spark.createDataFrame([(1, [1.0])], "doc_id long, embedding array<double>")
    assert retrieval.score_topk(none, d, 3).count() == 0


def test_metrics_perfect_and_unjudged(spark):
    qrels = spark.createDataFrame([(1, 10, 2), (1, 11, 1), (2, 20, 1)], "qid long, doc_id long, rel int")
    perfect = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (2, 20, 0.7, 1)],
                                    "qid long, doc_id long, score double, rank int")
    m = {(r["metric"], r["k"]): r["value"] for r in
         retrieval.retrieval_metrics(perfect, qrels, ks=[1, 2, 10]).collect()}
    assert m[("NDCG", 10)] == pytest.approx(1.0)
    assert m[("MAP", 10)] == pytest.approx(1.0)
    assert m[("Recall", 10)] == pytest.approx(1.0)
    assert m[("P", 1)] == pytest.approx(1.0)
    wrong = spark.createDataFrame([(1, 99, 0.9, 1), (2, 98, 0.8, 1)],
                                  "qid long, doc_id long, score double, rank int")
    m = {(r["metric"], r["k"]): r["value"] for r in
         retrieval.retrieval_metrics(wrong, qrels, ks=[1, 10]).collect()}
    assert all(v == 0 for v in m.values())


def test_self_exclusion_after_cut(spark):
    run = spark.createDataFrame([(1, 1, 1.0, 1), (1, 5, 0.5, 2), (1, 6, 0.4, 3)],
                                "qid long, doc_id long, score double, rank int")
    out = retrieval.exclude_self(run).orderBy("rank").collect()
    assert [(r["doc_id"], r["rank"]) for r in out] == [(5, 1), (6, 2)]


def test_pending_skips_existing(spark):
    req = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("a", 0.6)], "dataset string, threshold double")
    have = spark.createDataFrame([("a", 0.5)], "dataset string, threshold double")
    got = {tuple(r) for r in retrieval.pending(req, have, ["dataset", "threshold"]).collect()}
    assert got == {("b", 0.5), ("a", 0.6)}


def test_l2_normalize_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    got = [r[0] for r in df.select(retrieval.l2_normalize("v")).collect()]
    assert got[0] == [0.0, 0.0] and got[1] == pytest.approx([0.6, 0.8])


def test_rule_judgments_equal_explicit_qrels(spark):
    from glossa.plans.q_retrieval import f6, f6_judged
    from paths import SF_SMALL
    q, d = f6(spark, SF_SMALL)
    run = retrieval.exclude_self(retrieval.score_topk(q, d, 50))
    judged, grades = f6_judged(run, q, d)
    ks = [1, 5, 20, 1000]
    a = retrieval.metrics_from_judged(judged, retrieval.ideal_from_grades(grades, ["qid"], ks), ks)
    # the same judgments as an explicit table (fine at this size)
    qrels = (q.select("qid", "label").join(d.select("doc_id", "label"), "label")
             .filter(F.col("doc_id") != F.col("qid"))
             .select("qid", "doc_id", F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1).alias("rel")))
    b = retrieval.retrieval_metrics(run, qrels, ks)
    got = {(r["metric"], r["k"]): r["value"] for r in a.collect()}
    want = {(r["metric"], r["k"]): r["value"] for r in b.collect()}
    assert got.keys() == want.keys()
    for key in got:
        assert got[key] == pytest.approx(want[key], rel=1e-12), key


def test_scored_datasets_are_skipped(spark):
    from glossa.operators.encoder import HashedBagOfWords

    def lines(rows):
        return spark.createDataFrame(list(enumerate(rows)), "line_key long, value string")
    one = (lines(['{"_id": "q1", "text": "red fox"}']),
           lines(['{"_id": "12#3", "title": "", "text": "red fox"}', '{"x": {"title": "t", "text": "blue"}}']),
           lines(['{"query-id": "q1", "corpus-id": "12#3", "score": 1}']))

    datasets = {"done": (None, None, None), "new": one}
    have = spark.createDataFrame([("done",)], "dataset string")
    out = retrieval.evaluate_datasets(spark, datasets, HashedBagOfWords(16), "none", [1], existing=have)
    got = {(r["dataset"], r["metric"]): r["value"] for r in out.collect()}
    assert got == {("new", m): 1.0 for m in ("NDCG", "MAP", "Recall", "P")}
    all_done = spark.createDataFrame([("done",), ("new",)], "dataset string")
    assert retrieval.evaluate_datasets(spark, datasets, HashedBagOfWords(16), "none", [1], existing=all_done) is None


def test_datasets_go_through_one_plan(spark, tmp_path):
    from glossa.operators.encoder import HashedBagOfWords
    from glossa.sources import sinks

    def lines(rows):
        return spark.createDataFrame(list(enumerate(rows)), "line_key long, value string")

    def dataset(i):
        return (lines(['{"_id": "q", "text": "w%d"}' % i]), lines(['{"_id": "d", "text": "w%d"}' % i, '{"_id": "e", "text": "other"}']),
                lines(['{"query-id": "q", "corpus-id": "d", "score": 1}']))

    def jobs(n):
        group = f"datasets-{n}"
        spark.sparkContext.setJobGroup(group, "")
        path = str(tmp_path / group)
        out = retrieval.evaluate_datasets(spark, {f"s{i}": dataset(i) for i in range(n)}, HashedBagOfWords(64), "none", [1, 2],
                                          path=path)
        rows = {(r["dataset"], r["metric"], r["k"]): r["value"] for r in out.collect()}
        spark.sparkContext.setJobGroup("rest", "")
        assert len(rows) == n * 8 and all(rows[(f"s{i}", "NDCG", 1)] == 1.0 for i in range(n))
        assert sinks.existing_results(spark, path, ["dataset"]).count() == n
        assert retrieval.evaluate_datasets(spark, {"s0": (None, None, None)}, HashedBagOfWords(64), "none", [1], path=path) is None
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    assert abs(jobs(2) - jobs(6)) <= 2               # the planner may broadcast a table in one of them


def test_a_block_of_queries_sends_final_ranks_only(spark):
    """No candidates travel: the ranked rows come straight from the tasks, also
    where several document blocks and both rounds are needed; documents bring
    columns along; ids that several queries have are cut together."""
    rng = np.random.default_rng(11)
    d = rng.normal(size=(3000, 5)).astype(np.float32)
    d[200:260] = d[100]                                     # equal scores go to the lower id
    q = d[90:110]
    docs = _vec_df(spark, range(3000), d, "doc_id").withColumn("tag", F.col("doc_id") % 7).repartition(3)
    run = retrieval.score_topk(_vec_df(spark, range(20), q, "qid"), docs, 40, state_bytes=(5 * 12 + 40 * 24) * 4,
                               block_bytes=5 * 8 * 300, work_bytes=1 << 14, carry=["tag"])
    plan = run._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join LeftAnti" not in plan
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    s = np.round(unit(q) @ unit(d).T, 12)
    got = {}
    for r in run.collect():
        assert r["tag"] == r["doc_id"] % 7
        got.setdefault(r["qid"], []).append((r["rank"], r["doc_id"]))
    for i in range(20):
        want = sorted(range(3000), key=lambda j: (-s[i, j], j))[:40]
        assert sorted(got[i]) == list(enumerate(want, 1))
    twice = retrieval.score_topk(_vec_df(spark, [1, 1, 2], q[:3], "qid"), docs, 40)
    assert {r["qid"]: r["count"] for r in twice.groupBy("qid").count().collect()} == {1: 40, 2: 40}


def test_ranked_rows_leave_a_task_in_bounded_batches():
    import pyarrow as pa
    rng = np.random.default_rng(3)
    best = retrieval._Best([], pa.array(range(3000)), rng.normal(size=(3000, 4)), 50, 4, 1 << 20)
    for s in range(0, 400, 100):
        best.docs([pa.array(range(s, s + 100))], rng.normal(size=(100, 4)))
    out = pa.schema([("qid", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64()), ("rank", pa.int32())])
    sizes = [b.num_rows for b in best.best(out)]
    assert sum(sizes) == 3000 * 50 and max(sizes) <= retrieval.OUT_ROWS
    assert best.at.dtype == np.int32 and not best.waiting


def test_what_waits_and_is_held_is_bounded_in_any_order_of_documents(monkeypatch):
    """Every document is nearer to all queries than those before it, the worst
    order: memory stays near the best k of the queries, and columns are held
    of documents that are among the best, or new, only."""
    import tracemalloc

    import pyarrow as pa
    monkeypatch.setattr(retrieval, "HELD_ROWS", 2000, raising=False)
    k, n_q, n_d = 20, 1500, 12_000
    q = np.tile([1.0, 0.0], (n_q, 1)) + np.random.default_rng(5).normal(size=(n_q, 2)) * 1e-3
    angle = np.linspace(1.5, 0.1, n_d)
    d = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    best, held = retrieval._Best([], pa.array(range(n_q)), q.copy(), k, 2, 1 << 22), []
    tracemalloc.start()
    for s in range(0, n_d, 1000):
        best.docs([pa.array(range(s, s + 1000)), pa.array([f"t{i}" for i in range(s, s + 1000)])], d[s:s + 1000])
        held.append(sum(len(c[0]) for c in best.columns))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20                                  # all pairs of 1000 documents: 24 MB and their order
    assert max(held) <= 4000
    out = pa.schema([("qid", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64()), ("rank", pa.int32()), ("tag", pa.string())])
    rows = pa.Table.from_batches(best.best(out)).to_pylist()
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)
    score = np.round(unit @ (d / np.linalg.norm(d, axis=1, keepdims=True)).T, 12)
    want = np.argsort(-score, axis=1, kind="stable")[:, :k]
    assert [(r["qid"], r["doc_id"], r["rank"], r["tag"]) for r in rows] == [
        (i, int(j), n + 1, f"t{j}") for i in range(n_q) for n, j in enumerate(want[i])]
