from collections import defaultdict

import numpy as np

from glossa.llm import op1_ngrams as op
from llm_corpus import corpus, empty, sorted_rows, texts


def _sets(rows, k=5):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k
                   else frozenset([tuple(w)]) if w else frozenset())
    return out


def _expected(rows):
    sets = _sets(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    lists = defaultdict(list)
    for i, s in enumerate(sets):
        if rows[i][0] is not None:
            for x in s:
                lists[x].append(i)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s if rows[i][0] is not None else ():
            for j in lists[x]:
                shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [(key, len(sets[i]), None if key is None else least[find(i)]) for i, (key, _) in enumerate(rows)]


def test_components_against_all_pairs(spark, stored):
    got = sorted_rows(op.jaccard_components(stored), ["doc_id", "n_shingles", "component_id"])
    assert got == sorted(_expected(texts()), key=repr)


def test_chains_hot_groups_and_gray_zone(spark):
    """A chain of overlapping sets, a large group of near copies around one
    original, and neighbours just under the threshold."""
    rng = np.random.default_rng(0)
    word = lambda: "v%d" % rng.integers(0, 10 ** 9)
    rows, chain = [], [word() for _ in range(60)]
    for i in range(25):
        rows.append((i, " ".join(chain[i:] + [f"new{j}" for j in range(i)])))
    origin = [word() for _ in range(80)]
    for i in range(150):
        t = list(origin)
        for p in rng.integers(0, 80, int(rng.integers(0, 4))):
            t[p] = word()
        rows.append((1000 + int(rng.integers(0, 10 ** 6)) * 1000 + i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted_rows(op.jaccard_components(df), ["doc_id", "n_shingles", "component_id"])
    assert got == sorted(_expected(rows), key=repr)


def test_one_document_of_each_group_stays(spark, stored):
    kept = op.one_per_group(stored)
    assert kept.columns == stored.columns
    want = sorted((e[0] for e in _expected(texts()) if e[0] is None or e[0] == e[2]), key=repr)
    assert sorted((r[0] for r in kept.select("doc_id").collect()), key=repr) == want


def test_one_row_of_each_group_stays_where_ids_repeat(spark):
    """Ids that carry texts of different groups, and rows that are there
    more than once: a group keeps one row, never none."""
    text = lambda c: [f"{c}{i}" for i in range(60)]
    near = lambda c: " ".join(text(c)[:59] + ["other"])
    full = lambda c: " ".join(text(c))
    rows = [(5, full("a")), (9, near("a")), (3, full("b")), (5, near("b")),
            (5, full("c")), (7, near("c")), (4, full("d")), (4, full("d")), (4, near("d")), (8, near("d")),
            (6, full("e")), (6, full("f")), (None, full("a")), (None, full("a")), (2, None), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in op.one_per_group(df).collect()]
    group = lambda t: t and t[0]
    assert sorted(((d, group(t)) for d, t in kept), key=repr) == sorted(
        [(5, "a"), (3, "b"), (5, "c"), (4, "d"), (6, "e"), (6, "f"), (None, "a"), (None, "a"), (2, None), (2, None)], key=repr)


def test_empty_table(spark):
    assert op.jaccard_components(empty(spark)).count() == 0


def test_pointer_walk_finds_every_cluster_pair():
    rng = np.random.default_rng(2)
    e = np.zeros(400, dtype=op.ENTRY)
    e["h"], e["c"] = rng.integers(0, 12, 400), rng.integers(0, 60, 400)
    size = rng.integers(8, 40, 60)
    e["n"] = size[e["c"]]
    e["at"] = rng.integers(0, 6, 400)
    got = {(int(x), int(y)) for b in op.cluster_pairs(e) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    want = set()
    for h in range(12):
        rest = {}
        for r in e[e["h"] == h]:
            rest[int(r["c"])] = max(rest.get(int(r["c"]), 0), int(r["n"] - r["at"]))
        for x in rest:
            for y in rest:
                n, m = int(size[x]), int(size[y])
                if x > y and min(rest[x], rest[y]) >= op.needed(n, m) and 100 * min(n, m) >= 75 * max(n, m):
                    want.add((x, y))
    assert got == want


def test_partitioning_does_not_matter(spark):
    a = sorted_rows(op.jaccard_components(corpus(spark, 1)), ["doc_id", "n_shingles", "component_id"])
    assert a == sorted(_expected(texts()), key=repr)
