import numpy as np
import pytest

from glossa.operators import training
from paths import SF_SMALL


def _loss(x, enc, dec, k, aux_coeff, target):
    d = enc.shape[0]
    z = x @ enc.T
    raw = np.maximum(z, 0)
    if 0 < k < d:
        kth = -np.sort(-raw, axis=1)[:, k - 1]
        m = raw >= kth[:, None]
    else:
        kth = np.zeros(len(x))
        m = np.ones_like(raw, dtype=bool)
    f = raw * m
    mse = ((f @ dec - x) ** 2).mean()
    zz = np.clip((raw - kth[:, None]) * 1e4, -500, 500)
    usage = (1 / (1 + np.exp(-zz))).mean(axis=0)
    return mse + aux_coeff * (np.maximum(target - usage, 0) ** 2).mean()


def _atoms(spark, enc, dec):
    rows = [(i, [float(v) for v in e], [float(v) for v in d]) for i, (e, d) in enumerate(zip(enc, dec))]
    return spark.createDataFrame(rows, "feature int, enc array<double>, dec array<double>")


def _arrays(atoms):
    rows = sorted(atoms.collect(), key=lambda r: r["feature"])
    return np.array([r["enc"] for r in rows]), np.array([r["dec"] for r in rows])


@pytest.mark.parametrize("k,block_bytes", [(3, None), (3, 5 * 16 * 3), (0, None)])
def test_gradient_matches_finite_differences(spark, k, block_bytes):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 5))
    enc = rng.normal(size=(8, 5)) * 0.5
    dec = rng.normal(size=(8, 5)) * 0.5
    df = spark.createDataFrame([([float(v) for v in r],) for r in x] + [(None,), ([1.0],)], "embedding array<double>")
    res = training.fit_sae(df, 8, k, steps=1, lr=0.0, init=_atoms(spark, enc, dec))
    assert all(np.array_equal(a, b) for a, b in zip(_arrays(res.atoms), (enc, dec)))
    sizes = {} if block_bytes is None else {"max_block_bytes": block_bytes}
    model = training.load_model(_atoms(spark, enc, dec), k, **sizes)
    rows = {r["feature"]: r for r in training.gradients(df.repartition(3), model).collect()}
    ge = np.array([rows[f]["g_enc"] if f in rows else [0.0] * 5 for f in range(8)]) / 30
    gd = np.array([rows[f]["g_dec"] if f in rows else [0.0] * 5 for f in range(8)]) / 30
    assert rows[-1]["g_enc"][0] == 30
    h = 1e-6
    for (i, j) in [(0, 0), (3, 2), (7, 4)]:
        e2 = enc.copy(); e2[i, j] += h
        e1 = enc.copy(); e1[i, j] -= h
        num = (_loss(x, e2, dec, k, 0, 0) - _loss(x, e1, dec, k, 0, 0)) / (2 * h)
        assert ge[i, j] == pytest.approx(num, rel=1e-4, abs=1e-7)
        d2 = dec.copy(); d2[i, j] += h
        d1 = dec.copy(); d1[i, j] -= h
        num = (_loss(x, enc, d2, k, 0, 0) - _loss(x, enc, d1, k, 0, 0)) / (2 * h)
        assert gd[i, j] == pytest.approx(num, rel=1e-4, abs=1e-7)
    assert res.history[0]["mse_loss"] == pytest.approx(_loss(x, enc, dec, k, 0, 0))


def test_steps_do_not_depend_on_blocks_or_slices(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([([float(v) for v in r],) for r in rng.normal(size=(80, 6))], "embedding array<double>")
    args = dict(dict_size=20, sparsity=4, steps=2, lr=1e-2, aux_coeff=1.0, aux_target=0.3, batch_fraction=0.5,
                grad_acc_steps=2)
    one = training.fit_sae(df, **args)
    monkeypatch.setattr(training, "SLICE_BYTES", 16 * 6 * 3)       # three features a slice
    monkeypatch.setattr(training, "HELD_BYTES", 1)                 # every block's slices are sent at once
    monkeypatch.setattr(training, "many_tasks", lambda df: True)
    many = training.fit_sae(df.repartition(5), max_block_bytes=16 * 6 * 7, **args)
    assert len(one.history) == len(many.history) == 4
    for a, b in zip(one.history, many.history):
        assert a["n_rows"] == b["n_rows"] and a["loss"] == pytest.approx(b["loss"], rel=1e-9)
    for a, b in zip(_arrays(one.atoms), _arrays(many.atoms)):
        assert np.allclose(a, b, atol=1e-9)
    assert sum(h["n_rows"] for h in one.history) == 160


def test_loss_falls(spark):
    from glossa.plans.q_sae import fit_sae_loss
    rows = fit_sae_loss(spark, SF_SMALL).orderBy("step").collect()
    assert len(rows) == 6
    assert rows[-1]["mse_loss"] < rows[0]["mse_loss"]
