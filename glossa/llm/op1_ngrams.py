"""Operator 1: exact n-gram Jaccard join with set-relation skipping.

Words are lower-cased (A-Z); a document's set is its distinct 5-word
shingles.  Sets link at Jaccard >= 75 / 100.

1. *Survivors.*  A link needs three quarters of a set's shingles elsewhere,
   so a Count-min sketch over all sets (see ``ranged``: merged and answered
   by range of cells, it overestimates only) drops the documents that cannot link, and of the others keeps just
   the shingles that may be shared.  Equal sets become one class.
2. *Index.*  A global order puts shingles from rare to frequent (counts of a
   sketch over the classes); each class stores its prefix in that order, (1 -
   0.75) of the set, and enters it into the lists of its shingles.  Lists are packed and sliced by hash, so
   a task holds a slice, never a corpus.
3. *Leaders.*  In every list, members are verified against the list's
   smallest class only: a star, linear in the list.  A class that links to a
   leader (itself not linked to a smaller one) is attached to it, with its
   two differences to the leader's set.  Groups of thousands of near copies
   thus become one cluster.
4. *Index-level skipping.*  Lists now hold clusters, ordered by size and
   then by position; a probe leaves a list when sizes grow too large, and
   jumps to the next size as soon as positions are too deep for the overlap
   that is still needed.  No pair inside a cluster is ever formed.
5. *Answer-level skipping.*  A set z is intersected with the leader L only.
   For a member y the overlap follows from y's differences,
   ``|z & y| = |z & L| - |z & (L - y)| + |z & (y - L)|``, and the sizes of the
   differences alone settle most members.  As all members are connected
   through their leader, a pair of clusters is done at its first link.
6. Components of all links by alternating stars.

Large clusters are cut into units of ``UNIT`` members for step 5, and
verification groups are hash blocks whose number grows with the classes, so
no group is ever one task's whole work.

Shingles are 64-bit hashes (compared inside one pair of sets only); equal
sets are recognised by 128 bits, of which 64 name the class.

Defined cases: null, empty or white-space text has an empty set (0 shingles)
and is linked with nothing; with one to four words the whole sequence is the
one shingle; a null id is never linked and has a null component; rows of
equal ids are documents of their own that share the id; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import kernels
from glossa.llm.components import components
from glossa.llm.ranged import Estimates, merge_sketch, sketch_for
from glossa.llm.stages import small_batches, staged

SHINGLE = 5
PERCENT = 75
CELLS_PER_SHINGLE = 4
CHUNK_SHINGLES = 1 << 19
UNIT = 2048
GROUP_CLASSES = 2000
SLICE_ENTRIES = 1 << 19

ENTRY = np.dtype([("h", "<u8"), ("c", "<i8"), ("r", "<i8"), ("n", "<i4"), ("at", "<i4")])


def _least_part(n):
    """Smallest overlap of a set of ``n`` with any partner."""
    return -(-PERCENT * n // 100)


def needed(n, m):
    """Smallest overlap at which sets of ``n`` and ``m`` link."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def _sets(column, k: int):
    """Per text: the sorted distinct shingle hashes."""
    for pack in kernels.packs(column):
        w = kernels.words(pack)
        h = kernels.word_hashes(pack, w, lower=True)
        x = kernels.window_hashes(h, k)
        for i in range(pack.n):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a >= k:
                yield np.unique(x[a:b - k + 1])
            elif b > a:
                yield np.array([kernels.run_hash(h[a:b])], dtype=np.uint64)
            else:
                yield np.zeros(0, dtype=np.uint64)


def _chunks(batches, part_column: int, sets, size: int):
    """Cut a partition's rows into numbered chunks of about ``size`` shingles:
    (partition, number, pieces of 250 rows with their ``sets(piece)``)."""
    part, seq, held, n = 0, 0, [], 0
    for b in kernels.fixed_rows(batches, 250):
        part = b.column(part_column)[0].as_py()
        held.append((b, list(sets(b))))
        n += sum(map(len, held[-1][1]))
        if n >= size:
            yield part, seq, held
            seq, held, n = seq + 1, [], 0
    if held:
        yield part, seq, held


def _shingles(pieces) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(s for _, sets in pieces for s in sets)])


def _with_counts(batches, part_column: int, sets, size: int, sketch):
    """Pieces of ``_chunks`` with the estimated counts of each set."""
    told = None
    for part, seq, pieces in _chunks(batches, part_column, sets, size):
        told = told or Estimates(sketch, part)
        counts, at = told.counts(seq, _shingles(pieces)), 0
        for b, own in pieces:
            ends = at + np.cumsum([len(s) for s in own])
            yield b, own, np.split(counts[at:ends[-1]], ends[:-1] - at)
            at = ends[-1]


def _signed(x) -> int:
    x = int(x) & 0xFFFFFFFFFFFFFFFF
    return x - (1 << 64) if x >> 63 else x


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    return (_signed(kernels.mix64(s).sum(dtype=np.uint64)),
            _signed(kernels.mix64(s ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64) + np.uint64(len(s))))


def _text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that tell the texts of an id apart."""
    return F.xxhash64(text.cast("string")), F.xxhash64(F.lit(1), text.cast("string"))


def shingle_sets(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stage table: ``doc_id, t0, t1`` (``_text_key``), ``n_shingles``; for
    documents that may link also ``f0, f1`` (fingerprint of the set) and,
    once per task and set, the shared shingles ``tokens``."""
    t0, t1 = _text_key(F.col(text_col))
    texts = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("long").alias("_id"),
                        t0.alias("_t0"), t1.alias("_t1"), F.spark_partition_id().cast("long").alias("_part"))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    chunk = CHUNK_SHINGLES
    sets = lambda b: _sets(b.column(0), k)

    def chunks(batches):
        for part, seq, pieces in _chunks(batches, 4, sets, chunk):
            yield part, seq, _shingles(pieces)

    sketch = merge_sketch(texts, chunks, sketch_for(size // 6 + 1, CELLS_PER_SHINGLE, rows=1))

    def measure(batches):
        seen = set()
        for batch, own, counts in _with_counts(batches, 4, sets, chunk, sketch):
            out = []
            for key, t0, t1, s, times in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), own, counts):
                n = len(s)
                shared = s[times >= 2]
                if key is None or not n or len(shared) < _least_part(n):
                    out.append((key, t0, t1, n, None, None, None))
                    continue
                f = _fingerprint(s)
                out.append((key, t0, t1, n, *f, None if f in seen else shared.tobytes()))
                seen.add(f)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (*[pa.int64()] * 6, pa.binary()))],
                    names=["doc_id", "t0", "t1", "n_shingles", "f0", "f1", "tokens"])

    with small_batches(docs.sparkSession):
        return staged(texts.mapInArrow(measure, "doc_id long, t0 long, t1 long, n_shingles long, f0 long, f1 long, "
                                                "tokens binary"), "sets")


def _slices(spark: SparkSession, entries: int) -> tuple[int, int]:
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return parts, max(parts, entries // SLICE_ENTRIES)


def rare_prefixes(classes: DataFrame, total: int) -> DataFrame:
    """Stage table ``c, alone, prefix``: of each class (``c, n, tokens``; a
    stored table of ``total`` shingles) the shingles that it enters into the
    index, from rare to frequent, and how many of its own precede them."""
    placed = classes.select("c", "n", "tokens", F.spark_partition_id().cast("long").alias("part"))
    chunk = CHUNK_SHINGLES
    sets = lambda b: (np.frombuffer(t, np.uint64) for t in b.column(2).to_pylist())

    def chunks(batches):
        for part, seq, pieces in _chunks(batches, 3, sets, chunk):
            yield part, seq, _shingles(pieces)

    sketch = merge_sketch(placed, chunks, sketch_for(total + 1, CELLS_PER_SHINGLE, rows=1, most=255))

    def cut(batches):
        for batch, own, counts in _with_counts(batches, 3, sets, chunk, sketch):
            out = []
            for c, n, t, times in zip(*(batch.column(i).to_pylist() for i in range(2)), own, counts):
                alone = n - len(t)                       # shingles that no other set has: the rarest
                room = n - _least_part(n) + 1 - alone
                if room > 0:
                    out.append((c, alone, t[np.lexsort((t, times))[:room]].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))],
                    names=["c", "alone", "prefix"])

    return staged(placed.mapInArrow(cut, "c long, alone int, prefix binary"), "prefixes")


def _index(classes: DataFrame, slices: int, read) -> DataFrame:
    """Prefix entries of ``classes`` (``c, r, n, alone, prefix``), a row per slice and
    task, brought to the task of the slice, where ``read`` turns the sorted
    entries of a slice into record batches."""
    spark = classes.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def enter(batches):
        held, size = [], 0

        def flush():
            e = np.concatenate(held)
            s = ((e["h"] >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(s, kind="stable")
            e, s = e[order], s[order]
            at = np.append(np.flatnonzero(np.diff(s, prepend=-1)), len(s))
            return pa.RecordBatch.from_arrays(
                [pa.array(s[at[:-1]].astype(np.int32)), pa.array([e[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())],
                names=["slice", "entries"])

        for batch in batches:
            for c, r, n, alone, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
                t = np.frombuffer(raw, np.uint64)
                e = np.empty(len(t), dtype=ENTRY)
                e["h"], e["c"], e["r"], e["n"], e["at"] = t, c, r, n, alone + np.arange(len(t))
                held.append(e)
                size += len(e)
            if size >= SLICE_ENTRIES:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def lists(batches):
        now, held = None, []
        for batch in batches:
            for s, raw in zip(*(batch.column(i).to_pylist() for i in range(2))):
                if s != now and held:
                    yield from read(np.concatenate(held))
                    held = []
                now = s
                held.append(np.frombuffer(raw, ENTRY))
        if held:
            yield from read(np.concatenate(held))

    return (classes.mapInArrow(enter, "slice int, entries binary")
            .repartitionById(parts, F.col("slice") % parts).sortWithinPartitions("slice")
            .mapInArrow(lists, "x long, y long"))


def _pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    p = np.unique(np.stack([x, y], axis=1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["x", "y"])


def _size_fits(n, m):
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def leader_pairs(e: np.ndarray):
    """(member, leader) candidates of a slice: every entry with the class of
    smallest document id in its list, where sizes and positions allow a
    link."""
    e = e[np.lexsort((e["c"], e["r"], e["h"]))]
    first = np.flatnonzero(np.append(True, e["h"][1:] != e["h"][:-1])) if len(e) else np.zeros(0, int)
    lead = np.repeat(first, np.diff(np.append(first, len(e))))
    n, m = e["n"], e["n"][lead]
    rest = 1 + np.minimum(n - e["at"] - 1, m - e["at"][lead] - 1)
    ok = (e["c"] != e["c"][lead]) & _size_fits(n, m) & (rest >= needed(n.astype(np.int64), m.astype(np.int64)))
    yield _pairs(e["c"][ok], e["c"][lead][ok])


CLUSTER = np.dtype([("h", "<u8"), ("c", "<i8"), ("lo", "<i4"), ("hi", "<i4"), ("rest", "<i4")])


def cluster_pairs(e: np.ndarray, block: int = 1 << 20):
    """Candidate pairs of clusters of a slice (``c`` is the cluster).  A list
    is ordered by size, then by what is left behind the position; every
    probe has a pointer that moves on, jumps to the next size when the rest
    of its size block is too short, or stops when sizes are too large."""
    e = e[np.lexsort((e["c"], e["h"]))]
    if not len(e):
        return
    new = np.append(True, (e["h"][1:] != e["h"][:-1]) | (e["c"][1:] != e["c"][:-1]))
    at = np.flatnonzero(new)
    k = np.empty(len(at), dtype=CLUSTER)
    k["h"], k["c"] = e["h"][at], e["c"][at]
    k["lo"], k["hi"] = np.minimum.reduceat(e["n"], at), np.maximum.reduceat(e["n"], at)
    k["rest"] = np.maximum.reduceat(e["n"] - e["at"], at)
    k = k[np.lexsort((-k["rest"], k["lo"], k["h"]))]
    many = len(k)
    list_end = np.repeat(np.append(np.flatnonzero(k["h"][1:] != k["h"][:-1]) + 1, many),
                         np.diff(np.append(0, np.append(np.flatnonzero(k["h"][1:] != k["h"][:-1]) + 1, many))))
    size_new = np.append(True, (k["h"][1:] != k["h"][:-1]) | (k["lo"][1:] != k["lo"][:-1]))
    starts = np.append(np.flatnonzero(size_new), many)
    next_size = np.repeat(starts[1:], np.diff(starts))
    probe = np.arange(many)
    to = probe + 1
    xs, ys, held = [], [], 0
    lo, hi, rest = k["lo"].astype(np.int64), k["hi"].astype(np.int64), k["rest"].astype(np.int64)
    while len(probe):
        live = to < list_end[probe]
        probe, to = probe[live], to[live]
        o = needed(lo[probe], lo[to])
        live = (PERCENT * lo[to] <= 100 * hi[probe]) & (rest[probe] >= o)
        probe, to, o = probe[live], to[live], o[live]
        found = rest[to] >= o
        xs.append(k["c"][probe[found]])
        ys.append(k["c"][to[found]])
        held += int(found.sum())
        to = np.where(found, to + 1, next_size[to])
        if held >= block:
            yield _ordered(xs, ys)
            xs, ys, held = [], [], 0
    if held:
        yield _ordered(xs, ys)


def _ordered(xs, ys) -> pa.RecordBatch:
    x, y = np.concatenate(xs), np.concatenate(ys)
    return _pairs(np.maximum(x, y), np.minimum(x, y))


def _links(n, m, overlap) -> bool:
    return 100 * overlap >= PERCENT * (n + m - overlap)


def _in(sorted_set: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), dtype=bool)
    i = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[i] == values


def attached(classes: DataFrame, pairs: DataFrame, groups: int) -> DataFrame:
    """Verified links (y, leader) with y's differences to the leader."""
    p = pairs.select("x", "y", F.pmod(F.xxhash64("x"), F.lit(groups)).cast("int").alias("g"))
    need = p.select("g", F.col("x").alias("c")).unionByName(p.select("g", F.col("y").alias("c"))).distinct()
    null = lambda t: F.lit(None).cast(t)
    rows = (need.join(classes, "c").select("g", F.lit(0).alias("kind"), "c", F.col("n").cast("long").alias("n"), "tokens")
            .unionByName(p.select("g", F.lit(1).alias("kind"), F.col("x").alias("c"), F.col("y").alias("n"),
                                  null("binary").alias("tokens"))))

    def verify(batches):
        now, sets = None, {}
        for batch in batches:
            out = []
            for g, kind, c, n, raw in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if g != now:
                    now, sets = g, {}
                if kind == 0:
                    sets[c] = (n, np.frombuffer(raw, np.uint64))
                    continue
                (a, x), (b, y) = sets[c], sets[n]
                inside = _in(y, x)
                overlap = int(inside.sum())
                if _links(a, b, overlap):
                    out.append((c, n, a, x[~inside].tobytes(), y[~_in(x, y)].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                    names=["x", "y", "n", "plus", "minus"])

    return (rows.repartition("g").sortWithinPartitions("g", "kind")
            .mapInArrow(verify, "x long, y long, n long, plus binary, minus binary"))


class _Unit:
    """Part of a cluster: the leader's set (and whether the leader belongs to
    this part) and members as differences to it."""

    def __init__(self):
        self.own, self.n, self.tokens = False, 0, np.zeros(0, np.uint64)
        self.sizes, self.plus, self.minus, self._flat = [], [], [], None

    def add(self, n, plus, minus) -> None:
        self.sizes.append(n)
        self.plus.append(np.frombuffer(plus, np.uint64))
        self.minus.append(np.frombuffer(minus, np.uint64))

    def flat(self):
        if self._flat is None:
            self._flat = (np.asarray(self.sizes, np.int64), *[
                (np.concatenate(p) if p else np.zeros(0, np.uint64),
                 np.repeat(np.arange(len(p)), [len(v) for v in p]),
                 np.asarray([len(v) for v in p], np.int64)) for p in (self.plus, self.minus)])
        return self._flat

    def sets(self):
        if self.own:
            yield self.n, self.tokens
        for n, plus, minus in zip(self.sizes, self.plus, self.minus):
            yield n, np.sort(np.concatenate([self.tokens[~_in(np.sort(minus), self.tokens)], plus]))

    def links(self, n: int, z: np.ndarray) -> bool:
        """Whether any set of this unit links with ``z`` (of size ``n``): the
        overlap with the leader is computed, those with members derived."""
        with_leader = int(_in(z, self.tokens).sum())
        if self.own and _links(self.n, n, with_leader):
            return True
        if not self.sizes:
            return False
        sizes, (plus, plus_of, plus_n), (minus, minus_of, minus_n) = self.flat()
        o = needed(sizes, n)
        if (with_leader - minus_n >= o).any():
            return True                                    # settled by the sizes alone
        if not (with_leader + plus_n >= o).any():
            return False
        got = (with_leader + np.bincount(plus_of[_in(z, plus)], minlength=len(sizes))
               - np.bincount(minus_of[_in(z, minus)], minlength=len(sizes)))
        return bool((got >= o).any())

    def __len__(self) -> int:
        return len(self.sizes) + self.own


def cluster_links(classes: DataFrame, members: DataFrame, candidates: DataFrame, side: int) -> DataFrame:
    """One ``(x, y)`` row per candidate pair of clusters that has a link."""
    chunks = members.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / UNIT).cast("int").alias("chunks"))
    chunked = (members.join(chunks, "y").select(F.col("y").alias("lead"), F.pmod(F.xxhash64("x"), F.col("chunks")).cast("int")
                                                .alias("k"), "n", "plus", "minus"))
    units = chunks.select(F.col("y").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("k"))
    sides = (candidates.join(units.withColumnRenamed("lead", "x").withColumnRenamed("k", "kx"), "x", "left")
             .join(units.withColumnRenamed("lead", "y").withColumnRenamed("k", "ky"), "y", "left")
             .fillna(0, ["kx", "ky"]))
    block = lambda c, k: F.pmod(F.xxhash64(c, k), F.lit(side))
    pairs = sides.withColumn("g", (block("x", "kx") * side + block("y", "ky")).cast("int"))
    need = (pairs.select("g", F.col("x").alias("lead"), F.col("kx").alias("k"))
            .unionByName(pairs.select("g", F.col("y").alias("lead"), F.col("ky").alias("k"))).distinct())
    null = lambda t: F.lit(None).cast(t)
    leaders = (need.join(classes, need["lead"] == classes["c"])
               .select("g", F.lit(0).alias("kind"), "lead", "k", F.col("n").cast("long").alias("n"),
                       F.col("tokens").alias("plus"), null("binary").alias("minus"), F.lit(0).alias("ky")))
    parts = need.join(chunked, ["lead", "k"]).select("g", F.lit(1).alias("kind"), "lead", "k",
                                                     F.col("n").cast("long").alias("n"), "plus", "minus", F.lit(0).alias("ky"))
    asked = pairs.select("g", F.lit(2).alias("kind"), F.col("x").alias("lead"), F.col("kx").alias("k"),
                         F.col("y").alias("n"), null("binary").alias("plus"), null("binary").alias("minus"), "ky")

    def verify(batches):
        now, units_ = None, {}
        for batch in batches:
            xs, ys = [], []
            for g, kind, lead, k, n, plus, minus, ky in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if g != now:
                    now, units_ = g, {}
                if kind == 0:
                    u = units_[(lead, k)] = _Unit()
                    u.own, u.n, u.tokens = k == 0, n, np.frombuffer(plus, np.uint64)
                elif kind == 1:
                    units_[(lead, k)].add(n, plus, minus)
                else:
                    a, b = units_[(lead, k)], units_[(n, ky)]
                    if len(a) > len(b):
                        a, b = b, a
                    if any(b.links(m, z) for m, z in a.sets()):
                        xs.append(lead)
                        ys.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])

    return (leaders.unionByName(parts).unionByName(asked).repartition("g").sortWithinPartitions("g", "kind")
            .mapInArrow(verify, "x long, y long"))


def _classes_of(sets: DataFrame) -> DataFrame:
    """``f0, f1, copies, smallest``: per set that may link the number of its
    documents and the smallest ``(doc_id, t0, t1)`` of its component."""
    spark = sets.sparkSession
    named = sets.filter("f0 is not null")
    classes = staged(named.groupBy("f0", "f1").agg(
        F.min(F.struct("doc_id", "t0", "t1")).alias("least"), F.first("n_shingles").cast("int").alias("n"),
        F.count(F.lit(1)).alias("copies"), F.first("tokens", ignorenulls=True).alias("tokens"))
        .withColumn("c", F.col("f0")).withColumn("r", F.col("least.doc_id")), "classes")
    plain = classes.select("c", "r", "n", "tokens")
    many, total = plain.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0))).first()
    total //= 8
    entered = plain.select("c", "r", "n").join(rare_prefixes(plain, total), "c").select("c", "r", "n", "alone", "prefix")
    parts, slices = _slices(spark, total // 4)
    groups = max(parts, many // GROUP_CLASSES)
    stars = staged(_index(entered, slices, leader_pairs).distinct(), "stars")
    verified = staged(attached(plain, stars, groups), "verified")
    # a class is attached to its first leader that is no member itself
    roots = (verified.join(verified.select(F.col("x").alias("y")).distinct(), "y", "left_anti")
             .join(plain.select(F.col("c").alias("y"), "r"), "y"))
    members = staged(roots.groupBy("x").agg(F.min_by(F.struct("y", "n", "plus", "minus"), F.struct("r", "y")).alias("m"))
                     .select("x", "m.*"), "members")
    clustered = (entered.join(members.select(F.col("x").alias("c"), F.col("y").alias("lead")), "c", "left")
                 .select(F.coalesce("lead", "c").alias("c"), "r", "n", "alone", "prefix"))
    candidates = staged(_index(clustered, slices, cluster_pairs).distinct(), "candidates")
    side = max(4, math.isqrt(2 * groups))
    found = cluster_links(plain, members, candidates, side)
    joined = components(verified.select("x", "y").unionByName(found))
    comp = (classes.select("f0", "f1", "c", "least", "copies").join(joined.withColumnRenamed("id", "c"), "c", "left")
            .withColumn("label", F.coalesce("component", "c")))
    smallest = comp.groupBy("label").agg(F.min("least").alias("smallest"))
    return comp.join(smallest, "label").select("f0", "f1", "copies", "smallest")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, n_copies``: the smallest id that
    is reachable by links, and how many documents have the very same set
    (itself included)."""
    sets = shingle_sets(docs, SHINGLE, id_col, text_col)
    linked = (sets.filter("f0 is not null").select("doc_id", "n_shingles", "f0", "f1").join(_classes_of(sets), ["f0", "f1"])
              .select("doc_id", "n_shingles", F.col("smallest.doc_id").alias("component_id"), F.col("copies").alias("n_copies")))
    alone = sets.filter("f0 is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"),
                                             F.lit(1).cast("long").alias("n_copies"))
    return linked.unionByName(alone)


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per component, of its smallest id.  Rows that link
    with none, and rows of null ids, stay.  As an id may carry several
    texts, rows are told apart by id and text; where the row that stays is
    there more than once, one of its copies does."""
    sets = shingle_sets(docs, SHINGLE, id_col, text_col)
    key = ["doc_id", "t0", "t1"]
    rows = (sets.filter("f0 is not null").select(*key, "f0", "f1").join(_classes_of(sets), ["f0", "f1"])
            .groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.first("smallest").alias("smallest")))
    stays = F.struct(*key) == F.col("smallest")
    marks = staged(rows.filter(~stays | (F.col("rows") > 1)).select(*[F.col(c).alias(f"m_{c}") for c in key], stays.alias("stays")),
                   "marks")
    repeated = staged(marks.filter("stays"), "repeated")          # small or empty as a rule: no shuffle of texts then
    same = (F.col("doc_id") == F.col("m_doc_id")) & (F.col("t0") == F.col("m_t0")) & (F.col("t1") == F.col("m_t1"))
    # whole rows travel as one column, so that none of their names can clash
    named = [F.col(f"`{c}`") for c in docs.columns]
    plain = [c for (_, kind), c in zip(docs.dtypes, named) if "map<" not in kind]
    t0, t1 = _text_key(F.col(f"`{text_col}`"))
    packed = docs.select(F.struct(*named).alias("row"), F.xxhash64(*plain).alias("h"),
                         F.col(f"`{id_col}`").cast("long").alias("doc_id"), t0.alias("t0"), t1.alias("t1"))
    one = packed.join(repeated, same).groupBy("m_doc_id", "m_t0", "m_t1").agg(F.min_by("row", "h").alias("row"))
    # marks grow with the documents: the same shuffle at every size
    rest = packed.join(marks.hint("merge"), same, "left_anti")
    return rest.select("row").unionByName(one.select("row")).select("row.*")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs)
