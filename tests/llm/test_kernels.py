import random

import numpy as np
import pyarrow as pa

from glossa.llm import kernels as k
from glossa.llm import ranged, sketches
from glossa.llm.suffixes import first_owner, suffix_array


def test_words_and_hashes_per_text():
    texts = ["a b  a b", None, "", " \t x\ny\x0bz\x0c\r", "é ü é", "A a"]
    seen = {}
    for pack in k.packs(pa.array(texts), limit=6):
        w = k.words(pack)
        h = k.word_hashes(pack, w)
        low = k.word_hashes(pack, w, lower=True)
        for i in range(pack.n):
            part = [pack.data[a:b].tobytes() for a, b in zip(w.start[w.first[i]:w.first[i + 1]], w.end[w.first[i]:w.first[i + 1]])]
            assert part == (texts[pack.first + i] or "").encode().split()
            for word, x, y in zip(part, h[w.first[i]:w.first[i + 1]], low[w.first[i]:w.first[i + 1]]):
                assert seen.setdefault(word, x) == x
                assert seen.setdefault(word.lower(), y) == y
    assert len(set(seen.values())) == len(seen)


def test_window_hashes_depend_on_content_alone():
    random.seed(3)
    words = [str(random.randint(0, 3)) for _ in range(300)]
    pack = next(k.packs(pa.array([" ".join(words)])))
    h = k.word_hashes(pack, k.words(pack))
    for lane in (0, 1):
        x = k.window_hashes(h, 4, lane)
        by = {}
        for i, v in enumerate(x):
            assert by.setdefault(tuple(words[i:i + 4]), v) == v
        assert len(set(by.values())) == len(by)


def test_packed_differences_round_trip():
    rng = np.random.default_rng(0)
    for n in (1, 2, 1000):
        v = np.sort(rng.integers(0, 1 << 22, n))
        assert (sketches.unpack_sorted(sketches.pack_sorted(v)) == v).all()


def test_sketch_never_underestimates(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    values = np.concatenate([values, values[:700], values[:50]])
    df = spark.createDataFrame([(v.tobytes(),) for v in np.array_split(values, 9)], "raw binary").repartition(4)
    items = lambda b: (np.frombuffer(r, np.uint64) for r in b.column(0).to_pylist())
    cells = 1 << 13
    bits = sketches.load_sketch(sketches.build_sketch(df, items, cells), cells)
    u, n = np.unique(values, return_counts=True)
    hit = sketches.estimated_repeated(u, bits, cells)
    assert hit[n > 1].all() and hit[n == 1].mean() < 0.3
    counts = sketches.load_sketch(sketches.build_sketch(df, items, cells, rows=1, most=255), cells, rows=1, most=255)
    assert (sketches.estimated_count(u, counts, cells) >= n).all()


def test_ranges_pass_the_same_share_at_every_size(spark):
    """64 times the items mean 64 times the ranges of one size, the same
    share of single items that pass, and no repeated item lost."""
    rng = np.random.default_rng(2)
    passed = []
    for n in (2000, 128_000):
        values = rng.integers(0, 1 << 63, n).astype(np.uint64)
        values = np.concatenate([values, values[:n // 20]])
        rng.shuffle(values)
        packs = [(i, v.tobytes()) for i, v in enumerate(np.array_split(values, 20))]
        df = spark.createDataFrame(packs, "part long, raw binary").repartition(5)

        def chunks(batches):
            for b in batches:
                for part, raw in zip(*(c.to_pylist() for c in b.columns)):
                    yield part, 7, np.frombuffer(raw, np.uint64)

        sketch = ranged.sketch_for(n, 4, bits=10)
        assert sketch.ranges == -(-4 * n // 1024)
        sketch = ranged.merge_sketch(df, chunks, sketch)
        u, k = np.unique(values, return_counts=True)
        single, hits = dict(zip(u.tolist(), k.tolist())), []
        for part, raw in packs:
            h = np.frombuffer(raw, np.uint64)
            hit = ranged.Estimates(sketch, part).repeated(7, h)
            many = np.array([single[x] > 1 for x in h.tolist()])
            assert hit[many].all()
            hits.append(hit[~many])
        passed.append(np.concatenate(hits).mean())
    assert max(passed) < 0.09 and abs(passed[0] - passed[1]) < 0.03


def test_suffix_array_and_owners():
    random.seed(5)
    for _ in range(300):
        n, a = random.randint(1, 50), random.choice([1, 2, 3])
        text = [random.randint(1, a) for _ in range(n)] + [0]
        assert suffix_array(text) == sorted(range(n + 1), key=lambda i: text[i:])
    for _ in range(100):
        strings = [bytes(random.choice(b"ab") for _ in range(random.randint(1, 12))) for _ in range(random.randint(1, 5))]
        owners = [random.randint(0, 9) for _ in strings]
        got = first_owner(strings, owners, 4)
        for s, raw in enumerate(strings):
            want = [min(o for t, o in zip(strings, owners) if raw[i:i + 4] in t) for i in range(max(0, len(raw) - 3))]
            assert got[s] == want


def test_rows_are_cut_alike_however_they_come():
    rows = pa.table({"x": list(range(1003)), "t": [str(i) for i in range(1003)]})
    cuts = [[b.column(0).to_pylist() for b in k.fixed_rows(rows.to_batches(max_chunksize=n), 250)] for n in (7, 250, 1000, 5000)]
    assert cuts[0] == cuts[1] == cuts[2] == cuts[3] and [len(c) for c in cuts[0]] == [250, 250, 250, 250, 3]
    assert list(k.fixed_rows([], 250)) == []


def test_suffix_step_holds_numbers_only():
    """Large texts: 4-byte numbers a symbol instead of lists of objects, the
    same order and owners."""
    import random
    import tracemalloc
    from glossa.llm import suffixes
    rnd = random.Random(3)
    words = [bytes(rnd.randrange(97, 123) for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    strings = [b" ".join(rnd.choice(words) for _ in range(16))[:rnd.randrange(50, 80)] for _ in range(600)]
    strings += [strings[i][3:60] for i in range(0, 600, 7)]
    owners = [rnd.randrange(1000) for _ in strings]
    first = {}
    for s, of in zip(strings, owners):
        for i in range(len(s) - 19):
            first[s[i:i + 20]] = min(first.get(s[i:i + 20], of), of)
    tracemalloc.start()
    got = first_owner(strings, owners, 20)
    peak = tracemalloc.get_traced_memory()[1] / sum(len(s) + 1 for s in strings)
    tracemalloc.stop()
    assert [list(x) for x in got] == [[first[s[i:i + 20]] for i in range(len(s) - 19)] for s in strings]
    assert peak < 100
    text = [b + 2 for s in strings[:400] for b in s] + [0]
    assert len(text) > suffixes.LARGE
    raw = bytes(b - 1 if b else 0 for b in text)
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: raw[i:])
