"""SAE kernels: exactness against brute force, block chains, edge rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.operators import sae


def _atoms(spark, enc, dec=None):
    dec = enc if dec is None else dec
    rows = [(i, [float(v) for v in enc[i]], [float(v) for v in dec[i]]) for i in range(len(enc))]
    return spark.createDataFrame(rows, "feature int, enc array<double>, dec array<double>")


def _vecs(spark, x, extra=()):
    rows = [(i, [float(v) for v in x[i]], str(i % 3)) for i in range(len(x))] + list(extra)
    return spark.createDataFrame(rows, "id long, embedding array<float>, language string")


def _brute_topk(x, enc, k):
    raw = np.maximum(x.astype(np.float32).astype(np.float64) @ enc.T, 0)
    out = []
    for r in raw:
        order = sorted(range(len(r)), key=lambda j: (-round(r[j], 12), j))
        sel = order[:k] if 0 < k < len(r) else order
        out.append([(j, r[j]) for j in sel if r[j] > 0])
    return raw, out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    enc = rng.normal(size=(40, 8))
    x = rng.normal(size=(60, 8)).astype(np.float32)
    x[5] = 0.0                                   # zero vector
    enc[3] = enc[4]                              # duplicate atoms: exact ties
    return x, enc


@pytest.mark.parametrize("block_bytes", [sae.DEFAULT_BLOCK_BYTES, 8 * 8 * 2 * 7])
@pytest.mark.parametrize("k", [5, 0, 40, 100])
def test_topk_matches_brute_force(spark, data, block_bytes, k):
    x, enc = data
    model = sae.load_model(_atoms(spark, enc), sparsity=k, max_block_bytes=block_bytes)
    assert len(model.blocks) == (1 if block_bytes == sae.DEFAULT_BLOCK_BYTES else 6)
    got = {r["id"]: list(zip(r[sae.FEAT_IDX], r[sae.FEAT_VAL]))
           for r in sae.encode_topk(_vecs(spark, x), model).collect()}
    _, want = _brute_topk(x, enc, k)
    for i, w in enumerate(want):
        assert [j for j, _ in got[i]] == [j for j, _ in w]
        assert np.allclose([v for _, v in got[i]], [v for _, v in w])
    assert got[5] == []


def test_wrong_dimension_and_null_rows_give_no_features(spark, data):
    x, enc = data
    model = sae.load_model(_atoms(spark, enc), sparsity=5)
    df = _vecs(spark, x[:3], extra=[(100, [1.0, 2.0], "0"), (101, None, "1")])
    got = {r["id"]: r[sae.FEAT_IDX] for r in sae.encode_topk(df, model).collect()}
    assert got[100] == [] and got[101] == []
    assert len(got[0]) == 5
    check = sae.dimension_check(df, 8).first()
    assert check["n_bad"] == 2
    with pytest.raises(ValueError):
        sae.assert_dimension(df, 8)


@pytest.mark.parametrize("block_bytes", [sae.DEFAULT_BLOCK_BYTES, 8 * 8 * 2 * 9])
def test_decode_and_firing_counts_across_blocks(spark, data, block_bytes):
    x, enc = data
    rng = np.random.default_rng(3)
    dec = rng.normal(size=enc.shape)
    model = sae.load_model(_atoms(spark, enc, dec), sparsity=6, max_block_bytes=block_bytes)
    df = _vecs(spark, x)
    rec = {r["id"]: np.array(r[sae.RECON]) for r in
           sae.decode(sae.encode_topk(df, model), model).collect()}
    raw, want = _brute_topk(x, enc, 6)
    for i, w in enumerate(want):
        expect = sum((v * dec[j] for j, v in w), np.zeros(8))
        assert np.allclose(rec[i], expect)
    counts = {(r["language"], r["feature"]): r["n"]
              for r in sae.firing_counts(df, model).collect()}
    for lang in ("0", "1", "2"):
        rows = [i for i in range(len(x)) if str(i % 3) == lang]
        fired = (raw[rows] > 1e-6).sum(axis=0)
        for f in range(len(enc)):
            assert counts.get((lang, f), 0) == fired[f]


def test_metrics_same_for_one_block_and_many(spark, data):
    x, enc = data
    df = _vecs(spark, x)
    a = sae.evaluate(df, sae.load_model(_atoms(spark, enc), 6), aux_coeff=1.0,
                     aux_target=0.05).first().asDict()
    b = sae.evaluate(df, sae.load_model(_atoms(spark, enc), 6, max_block_bytes=8 * 8 * 2 * 11),
                     aux_coeff=1.0, aux_target=0.05).first().asDict()
    for key in a:
        assert a[key] == pytest.approx(b[key], rel=1e-9, abs=1e-12), key
    assert a["l0"] <= 6


def test_empty_mask_and_full_mask(spark, data):
    x, enc = data
    model = sae.load_model(_atoms(spark, enc), 6)
    df = _vecs(spark, x)
    plain = {r["id"]: r[sae.FEAT_IDX] for r in sae.encode_topk(df, model).collect()}
    empty = {r["id"]: r[sae.FEAT_IDX] for r in sae.encode_topk(df, model, mask_features=[]).collect()}
    full = sae.encode_topk(df, model, mask_features=range(40))
    assert plain == empty
    assert full.filter(F.size(sae.FEAT_IDX) > 0).count() == 0
    rec = sae.decode(full, model).select(sae.RECON).collect()
    assert all(not any(v != 0 for v in r[0]) for r in rec)


def test_empty_table(spark, data):
    _, enc = data
    model = sae.load_model(_atoms(spark, enc), 6)
    empty = spark.createDataFrame([], "id long, embedding array<float>, language string")
    assert sae.encode_topk(empty, model).count() == 0
    assert sae.firing_counts(empty, model).count() == 0


def test_bad_dictionary_rejected(spark, data):
    _, enc = data
    atoms = _atoms(spark, enc).filter(F.col("feature") != 3)
    with pytest.raises(ValueError):
        sae.load_model(atoms, 4)


def test_raw_stats_across_blocks(spark, data):
    x, enc = data
    df = _vecs(spark, x)
    one = {r["id"]: (r["n_fired"], r["raw_sum"], r["raw_max"]) for r in
           sae.raw_activation_stats(df, sae.load_model(_atoms(spark, enc), 5)).collect()}
    many = {r["id"]: (r["n_fired"], r["raw_sum"], r["raw_max"]) for r in
            sae.raw_activation_stats(df, sae.load_model(_atoms(spark, enc), 5,
                                                        max_block_bytes=8 * 8 * 2 * 9)).collect()}
    raw, _ = _brute_topk(x, enc, 5)
    for i in range(len(x)):
        assert one[i][0] == many[i][0] == int((raw[i] > 1e-6).sum())
        assert one[i][1] == pytest.approx(raw[i].sum()) and many[i][1] == pytest.approx(raw[i].sum())
        assert one[i][2] == pytest.approx(raw[i].max()) and many[i][2] == pytest.approx(raw[i].max())


def _nodes(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


def test_one_node_whatever_the_blocks(spark, data):
    x, enc = data
    df = _vecs(spark, x)
    for block_bytes in (sae.DEFAULT_BLOCK_BYTES, 8 * 8 * 2 * 7):
        model = sae.load_model(_atoms(spark, enc), 6, max_block_bytes=block_bytes)
        for out in (sae.encode_topk(df, model), sae.raw_activation_stats(df, model),
                    sae.reconstruct(df, model, mask_features=[1])):
            assert _nodes(out) == 1


def test_a_task_holds_less_than_two_blocks(tmp_path):
    """Six blocks of 4 MB, mapped: what the kernel allocates stays below one."""
    import tracemalloc
    from glossa.operators.weights import Block, SaeModel
    rng = np.random.default_rng(4)
    dim, rows, blocks = 64, 4096, 6
    enc = rng.normal(size=(rows * blocks, dim))
    parts = []
    for b in range(blocks):
        path = str(tmp_path / f"{b}.enc")
        enc[b * rows:(b + 1) * rows].astype("<f8").tofile(path)
        parts.append(Block(b * rows, (b + 1) * rows, path, path))
    model = SaeModel(dim, rows * blocks, 16, parts)
    x = rng.normal(size=(1000, dim))
    model.enc(parts[0])
    tracemalloc.start()
    idx, val, _ = sae.topk_rows(model, x, 16, work_bytes=1 << 18)
    sae.decoded_rows(model, idx, val, work_bytes=1 << 18)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * rows * dim * 8
    raw = np.maximum(x @ enc.T, 0)
    assert np.array_equal(np.sort(idx, axis=1), np.sort(np.argsort(-raw, axis=1)[:, :16], axis=1))


@pytest.mark.parametrize("block_bytes", [sae.DEFAULT_BLOCK_BYTES, 8 * 8 * 2 * 7])
def test_both_reconstructions_in_one_pass(spark, data, block_bytes):
    x, enc = data
    dec = np.random.default_rng(9).normal(size=enc.shape)
    model = sae.load_model(_atoms(spark, enc, dec), 6, max_block_bytes=block_bytes)
    mask = [0, 4, 7, 30]
    got = sae.reconstruct(_vecs(spark, x, extra=[(100, None, "0")]), model, mask_features=mask).collect()
    _, want = _brute_topk(x, enc, 6)
    for r in got:
        pairs = want[r["id"]] if r["id"] < 100 else []
        assert np.allclose(r[sae.RECON], sum((v * dec[j] for j, v in pairs), np.zeros(8)))
        assert np.allclose(r[sae.RECON_MASKED], sum((v * dec[j] for j, v in pairs if j not in mask), np.zeros(8)))
    ranked = {r["id"]: list(zip(r[sae.FEAT_RANK], r[sae.FEAT_IDX])) for r in
              sae.encode_topk(_vecs(spark, x), model, mask_features=mask, ranks=True).collect()}
    for i, w in enumerate(want):
        assert ranked[i] == [(n + 1, j) for n, (j, _) in enumerate(w) if j not in mask]


def test_firing_counts_in_two_levels(spark, data, monkeypatch):
    from glossa.operators import partials
    x, enc = data
    df = _vecs(spark, x, extra=[(200, [1.0] * 8, None)]).repartition(12)
    model = sae.load_model(_atoms(spark, enc), 5)
    one = sorted(map(tuple, sae.firing_counts(df, model).collect()), key=repr)
    monkeypatch.setattr(sae, "many_tasks", lambda df: True)
    monkeypatch.setattr(partials, "RANGE", 7)
    monkeypatch.setattr(sae, "HELD_BYTES", 100)          # every batch is sent at once
    two = sae.firing_counts(df, model)
    assert sorted(map(tuple, two.collect()), key=repr) == one
    assert any(r[0] is None for r in one)
    metrics = [sae.evaluate(df, model, aux_coeff=1.0, aux_target=0.3).first().asDict()]
    monkeypatch.undo()
    metrics.append(sae.evaluate(df, model, aux_coeff=1.0, aux_target=0.3).first().asDict())
    for key in metrics[0]:
        assert metrics[0][key] == pytest.approx(metrics[1][key], rel=1e-12)


def test_ten_thousand_batches_one_at_a_time(spark, data):
    """A task keeps the sums of one batch; a batch of many rows is cut."""
    x, enc = data
    model = sae.load_model(_atoms(spark, enc), 6)
    base = _vecs(spark, x).withColumn("batch", (F.col("id") / 7).cast("long"))
    want = {r["batch"]: r.asDict() for r in sae.evaluate(base, model, group_col="batch", aux_coeff=1.0).collect()}
    cut = {r["batch"]: r.asDict() for r in
           sae.evaluate(base, model, group_col="batch", aux_coeff=1.0, segment_rows=2).collect()}
    assert len(want) == 9 and sum(r["n_rows"] for r in want.values()) == 60
    for b, r in want.items():
        for key in r:
            assert cut[b][key] == pytest.approx(r[key], rel=1e-9, abs=1e-12)
        rows = x[b * 7:b * 7 + 7].astype(float)
        assert r["mse_loss"] == pytest.approx(sae.evaluate(base.filter(F.col("batch") == b), model).first()["mse_loss"]) \
            if b < 2 else r["n_rows"] == len(rows)
    many = spark.range(0, 10_000, numPartitions=2).crossJoin(base.filter("id < 1").select("embedding")) \
        .withColumnRenamed("id", "batch")
    per = sae.evaluate(many, model, group_col="batch")
    assert per.count() == 10_000
    weighted = sae.batch_weighted(per).first()
    assert weighted["n_rows"] == 10_000 and weighted["mse_loss"] == pytest.approx(per.first()["mse_loss"])
