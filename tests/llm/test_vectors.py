"""Whitening and vector codes against plain statements, and their cases."""

import hashlib
import math

import numpy as np
import pytest

from glossa.llm import op11_whitening as white
from glossa.llm import op12_codes as codes
from glossa.llm.secular import rank_one
from llm_corpus import SF

SCHEMA = ("vec_id long, embedding array<float>, label int, x string, state int, sums long, key string, `a.b` int, "
          "code int, error int, vec int")


def awkward(spark, n=700, dim=16, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)) * np.linspace(0.2, 1.5, dim)
    rows = [(int(i), [float(v) for v in r], None if i % 13 == 0 else int(i % 4)) for i, r in enumerate(base)]
    rows += [(3, rows[3][1], 1)] * 40 + [(9000 + i, rows[5][1], 2) for i in range(300)]       # repeats, copies
    rows += [(-4, [0.0] * dim, 0), (None, rows[6][1], 3), (None, None, 3), (8001, None, 1), (8002, [], 1),
             (8003, [1.0] * (dim - 1), 1), (8004, [1.0] * (dim - 1) + [None], 1),
             (8005, [float("nan")] + [1.0] * (dim - 1), 1), (8006, [float("inf")] + [1.0] * (dim - 1), 1)]
    wide = [(*r, "c", 1, 2, "k", 3, 4, 5, 6) for r in rows]
    return spark.createDataFrame(wide, SCHEMA).repartition(5), rows


def usable(rows, dim=16):
    return [(k, np.array(v, np.float32).astype(float), lab) for k, v, lab in rows
            if v is not None and len(v) == dim and None not in v and all(math.isfinite(x) for x in v)]


def test_rank_one_updates():
    rng = np.random.default_rng(1)
    for m in (1, 2, 7, 20):
        lam, q = np.zeros((3, m)), np.broadcast_to(np.eye(m), (3, m, m)).copy()
        a = np.zeros((3, m, m))
        for step in range(60):
            v = rng.normal(size=(3, m))
            v[0] = np.round(v[0])                     # ties
            v[1] = v[1] * 0 + 3 if step % 3 else v[1]  # the same vector again
            v[2, : m // 2] = 0                        # poles without weight
            rho = np.array([1.0, 0.5, 0.0 if step % 5 == 0 else 2.0])
            lam, q = rank_one(lam, q, v, rho)
            a += rho[:, None, None] * v[:, :, None] * v[:, None, :]
        back = np.matmul(q * lam[:, None, :], q.transpose(0, 2, 1))
        assert np.abs(back - a).max() < 1e-9 * np.abs(a).max()
        assert np.abs(np.matmul(q.transpose(0, 2, 1), q) - np.eye(m)).max() < 1e-12
        assert np.abs(lam - np.linalg.eigvalsh(a)).max() < 1e-9 * np.abs(a).max()


def check_whitening(df, vectors, components=32):
    x = np.array([[math.floor(64 * v) + 1_000_000 for v in r] for _, r, _ in vectors], dtype=object)
    n = len(x)
    sums = x.sum(axis=0)
    centred = np.array([[float(int(v) * n - int(s)) / n for v, s in zip(r, sums)] for r in x])
    cov = centred.T @ centred / n
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    rows = df.collect()
    k = min(components, x.shape[1])
    assert len(rows) == n * k
    assert {r["n"] for r in rows} == {n}
    deviation = sorted(sum((n * int(v) - int(s)) ** 2 for v, s in zip(r, sums)) for r in x)
    assert sorted(r["deviation"] for r in rows if r["component"] == 1) == deviation
    explained = {r["component"]: r["explained"] for r in rows}
    assert np.allclose([explained[c + 1] for c in range(k)], value[:k] / np.trace(cov), rtol=1e-9)
    error = {r["identity_error"] for r in rows}
    assert len(error) == 1 and 0 <= error.pop() < 1e-9
    got = {}
    for r in rows:
        got.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    want = centred @ vector[:, :k] / np.sqrt(value[:k])
    sign = None
    for (key, _, _), dev, w in zip(vectors, [sum((n * int(v) - int(s)) ** 2 for v, s in zip(r, sums)) for r in x], want):
        have = np.array([got[(key, dev)][c + 1][0] for c in range(k)])
        if sign is None:
            sign = np.sign(have * w)
        assert np.allclose(have, w * sign, atol=1e-6), key


def test_whitening_equals_the_plain_decomposition(spark):
    df, rows = awkward(spark)
    w = white.fit(df)
    assert np.allclose(w.start[:16], w.variances, rtol=1e-8)      # the incremental spectrum alone is close already
    check_whitening(white.whiten(df, w), usable(rows))


def test_whitening_query(spark):
    import pyarrow.parquet as pq
    rows = [(r["vec_id"], np.array(r["embedding"], float), r["label"])
            for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    check_whitening(white.op11_whitening(spark, SF), rows)


def test_whitening_without_variance(spark):
    flat = spark.createDataFrame([(i, [1.0, 2.0, float(i % 2)]) for i in range(20)], "vec_id long, embedding array<double>")
    w = white.fit(flat)
    assert w.components.shape == (3, 1) and abs(w.explained[0] - 1) < 1e-12
    assert white.fit(flat.filter("vec_id = 0")) is None
    assert white.fit(flat.filter("vec_id < 0")) is None
    assert white.fit(flat.selectExpr("vec_id", "cast(null as array<double>) as embedding")) is None


def test_whitening_joins_many_tasks(spark):
    df, rows = awkward(spark, n=300)
    one, many = white.fit(df.coalesce(1)), white.fit(df.repartition(40))
    assert one.n == many.n == len(usable(rows)) and list(one.sums) == list(many.sums)
    assert np.allclose(one.start, many.start, rtol=1e-8, atol=1e-9)


def plain_codes(vectors, parts=4, entries=256, rounds=4):
    order = sorted(vectors, key=lambda r: (r[0] is None, r[0]))
    x = np.array([[math.floor(1024 * v) for v in r] for _, r, _ in order], dtype=np.int64)
    width = x.shape[1] // parts
    book = [x[:entries, p * width:(p + 1) * width].copy() for p in range(parts)]

    def near(p):
        part = x[:, p * width:(p + 1) * width]
        d = ((part[:, None, :] - book[p][None]) ** 2).sum(axis=2)
        return part, d.argmin(axis=1), d.min(axis=1)
    for _ in range(rounds):
        for p in range(parts):
            part, a, _ = near(p)
            for e in range(len(book[p])):
                mine = part[a == e]
                if len(mine):
                    book[p][e] = mine.sum(axis=0) // len(mine)
    found = [near(p) for p in range(parts)]
    code = ["".join(f"{found[p][1][i]:02x}" for p in range(parts)) for i in range(len(x))]
    error = sum(f[2] for f in found)
    by_label = {}
    for (_, _, lab), e in zip(order, error):
        by_label[lab] = by_label.get(lab, 0) + int(e)
    digest = hashlib.sha256(",".join(str(v) for p in range(parts) for e in book[p] for v in e).encode()).hexdigest()
    return sorted([(k, c, int(e), by_label[lab], digest) for (k, _, lab), c, e in zip(order, code, error)], key=repr)


COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_codes_equal_full_scans(spark):
    df, rows = awkward(spark)
    coded, history, record = codes.compress(df)
    full, same, counted = codes.compress(df, use_bounds=False)
    assert all(np.array_equal(a, b) for a, b in zip(history, same))
    assert sorted(map(tuple, coded.collect()), key=repr) == sorted(map(tuple, full.collect()), key=repr)
    assert [r["rows"] for r in record] == [len(usable(rows))] * 4
    assert record[-1]["distances"] < 0.6 * counted[-1]["distances"]          # the bounds leave most entries alone
    import pyspark.sql.functions as F
    got = codes.with_label_error(coded).withColumn("codebooks_sha256", F.lit(codes.book_digest(history[-1])))
    assert sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=repr) == plain_codes(usable(rows))


def test_codes_query(spark):
    import pyarrow.parquet as pq
    rows = [(r["vec_id"], np.array(r["embedding"], float), r["label"])
            for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    got = codes.op12_vector_codes(spark, SF).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == plain_codes(rows)


def test_codes_of_few_and_no_rows(spark):
    df, rows = awkward(spark, n=10)
    few = df.filter("vec_id < 7 and vec_id <> 3")
    coded, history, _ = codes.compress(few)
    kept = [r for r in usable(rows) if r[0] is not None and r[0] < 7 and r[0] != 3]
    assert history[0].shape == (4, len(kept), 4)
    assert [r["error"] for r in coded.collect()] == [0] * len(kept)
    none, empty, _ = codes.compress(df.filter("vec_id > 100000"))
    assert none.count() == 0 and empty == []
    with pytest.raises(ValueError):
        codes.compress(df, parts=5)


def test_net_displacement_is_the_tighter_bound():
    """An entry that moves away and back: the net displacement is zero where
    the sum of the moves is not, so no distance is taken anew but the own."""
    base = np.array([[[0, 0], [100, 0], [0, 100], [100, 100]]], dtype=np.int64)
    there = base + 30
    groups = [[np.array([i]) for i in range(4)]]
    rng = np.random.default_rng(3)
    x = (base[0][rng.integers(0, 4, 500)] + rng.integers(-8, 9, (500, 2))).astype(np.int64)
    state = np.zeros(500, codes.state_type(1, 4))
    state["u"] = np.inf
    codes.Rounds([base], groups).assign(x, state)
    back = codes.Rounds([base, there, base], groups)
    back.assign(x, state.copy())
    assert back.distances == 0
