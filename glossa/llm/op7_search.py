"""Operator 7: exact BM25 top-k search with block-max pruning, per shard.

1. *Index.*  Every task turns its documents into shards of about
   ``SHARD_BYTES`` of text: an inverted index over 64-bit word hashes
   (lower-cased A-Z), documents ordered by their most frequent word and
   length, so that blocks of ``BLOCK`` neighbours are alike.  Any cut into
   shards gives the same result, so nothing is shuffled; a shard is a file, so
   that any number of tasks can read them, and the shards of a round a folder.
2. *Global statistics.*  Documents, words and, for the words of the queries,
   document frequencies are summed over all shards.
3. *Search.*  Queries go in blocks of at most ``QUERY_BLOCK`` (and
   ``QUERY_BYTES`` of words), each broadcast to all shards.  A shard is loaded
   once for a block and takes ``TILE`` queries at a time, ordered by their
   most common word.  Lists of rare words are added up per query; common words
   are the columns of a dense table.  The sums, with the block maxima of the
   columns, bound what any document of a block can score.  Blocks that reach
   the k-th best score of earlier rounds for a query of the tile are opened:
   matrix products score them for the tile.  Without such a score the
   ``FIRST_BLOCKS`` blocks of highest bound come first; the floor rises with
   every ``RUN`` of blocks.  All this is in single precision with ``SLACK``;
   the documents that may be among the best are scored in double precision.
4. *Merge.*  Shards are searched in rounds (about 1/16, 3/16 and the rest of
   them, by hash): the merged k-th best score of a round is where the next
   one starts, so later shards open fewer blocks and send little.  The result
   is the top k of all rounds by score and id.

Scores add terms in the order of their hash in double precision, so they do
not depend on the sharding; ranks compare scores at nine decimals, equal
ones by id.  BM25: idf ``ln(1 + (N - df + 0.5) / (df + 0.5))``, k1 1.2,
b 0.75, each distinct query word once.

Defined cases: null or empty text is a document of length 0 that no query
finds, and a query without results; null ids are found (rank after other
equal scores) but are no queries; rows of equal ids are documents, and
queries, of their own;
documents that share no word with a query are not listed, so a query may
have fewer than k rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.llm import kernels
from glossa.llm.stages import stage_path, staged

K = 10
K1, B = 1.2, 0.75
SHARD_BYTES = 32 << 20
REST = 4              # a rest of less than a fourth goes to the shard before
BLOCK = 32
QUERY_BLOCK = 8192
QUERY_BYTES = 64 << 20
FIRST_BLOCKS = 16
COMMON, COMMON_SHARE = 768, 40   # columns of common words at most, and in which share of the documents
TILE, TILE_BYTES = 256, 32 << 20  # queries at once, and bytes of their sums, or of the columns, at most
GROUP = 4                        # tiles that share their columns
RUN = 64                         # neighbouring blocks that are scored at once, at most
SLACK = 2e-4                     # over the rounding of single precision in sums of COMMON columns
FEW, PAIRS = 256, 4096           # documents of a query, and pairs at once, that are scored by their words
ROUNDS = (1, 4, 16)   # sixteenths of the shards searched after each round
NO_ID = (1 << 63) - 1

SHARD = ("n_docs long, n_words long, ids binary, lengths binary, terms binary, first binary, docs binary, "
         "counts binary")


def _z(a: np.ndarray) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _u(raw: bytes, kind) -> np.ndarray:
    import zstandard
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _order(values: np.ndarray) -> np.ndarray:
    """Places of ``values`` in rising order, equal ones in any order: the
    upper bits are sorted with the place in the lower ones, which is several
    times faster; if these bits do not tell all values apart, by all bits."""
    low = np.uint64((1 << len(values).bit_length()) - 1)
    order = values & ~low
    order |= np.arange(len(values), dtype=np.uint64)
    order.sort()
    order &= low
    order = order.view(np.int64)
    sorted_ = values[order]
    return order if (sorted_[1:] >= sorted_[:-1]).all() else np.argsort(values)


def _shard(ids, doc, term, lengths) -> tuple:
    """Index of documents ``0 .. n`` given (document, word) pairs."""
    n = len(ids)
    order = _order(term)
    pairs = term[order]
    new = np.append(True, pairs[1:] != pairs[:-1])[:len(pairs)]
    words = pairs[new]
    pairs = np.cumsum(new)
    pairs -= 1
    pairs *= n
    pairs += doc[order]
    del order, new
    pairs.sort()                                               # by word, then document
    at = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.zeros(0, np.int64)
    tf = np.diff(np.append(at, len(pairs)))
    t, d = np.divmod(pairs[at], n)
    # neighbours alike: by the most frequent word, then by length
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, d, tf)
    lead = np.flatnonzero(tf == most[d])[::-1]                 # of equal ones the last that is set, the smallest word
    top = np.zeros(n, dtype=np.uint64)
    top[d[lead]] = words[t[lead]]
    place = np.empty(n, dtype=np.int64)
    seats = np.lexsort((np.arange(n), lengths, top))
    place[seats] = np.arange(n)
    d = place[d]
    order = np.argsort(t * n + d)
    d, tf = d[order], tf[order]
    first = np.append(np.searchsorted(t, np.arange(len(words))), len(t))
    return (n, int(lengths.sum()), _z(ids[seats]), _z(lengths[seats].astype("<i4")), _z(words),
            _z(first.astype("<i8")), _z(d.astype("<i4")), _z(tf.astype("<i4")))


def build_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def build(batches):
        def fresh():
            return {"ids": [], "doc": [], "term": [], "len": [], "rows": 0, "size": 0}

        def index(*parts):
            rows = np.cumsum([0] + [p["rows"] for p in parts])
            for p, shift in zip(parts, rows):
                p["doc"] = [d + shift for d in p["doc"]] if shift else p["doc"]
            held = {k: [x for p in parts for x in p.pop(k)] for k in ("ids", "doc", "term", "len")}
            got = _shard(*(np.concatenate(held.pop(k)) for k in ("ids", "doc", "term", "len")))
            return pa.RecordBatch.from_arrays(
                [pa.array([v], pa.int64() if i < 2 else pa.binary()) for i, v in enumerate(got)],
                names=[c.split()[0] for c in SHARD.split(", ")])

        full, held = None, fresh()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for pack in kernels.packs(part.column(0)):
                    w = kernels.words(pack)
                    held["term"].append(kernels.word_hashes(pack, w, lower=True))
                    held["len"].append(w.counts().astype(np.int64))
                    held["doc"].append(np.repeat(np.arange(held["rows"] + pack.first, held["rows"] + pack.first + pack.n,
                                                           dtype=np.int32), w.counts()))
                    held["size"] += len(pack.data)
                held["ids"].append(part.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64))
                held["rows"] += part.num_rows
                if full and held["size"] * REST >= SHARD_BYTES:
                    yield index(full)
                    full = None
                if held["size"] >= SHARD_BYTES:
                    full, held = held, fresh()
        parts = [p for p in (full, held) if p and p["rows"]]
        if parts:
            yield index(*parts)                                # a small rest is no shard of its own

    texts = docs.select(F.col(text_col).cast("string").alias("_t"), F.col(id_col).cast("long").alias("_id"))
    shards = texts.mapInArrow(build, SHARD).withColumn("turn", F.pmod(F.xxhash64("ids"), F.lit(ROUNDS[-1])).cast("int"))
    path = stage_path(docs.sparkSession, "shards")
    # a file a shard: any number of tasks can read them, so they are never shuffled
    shards.write.option("maxRecordsPerFile", 1).partitionBy("turn").parquet(path)
    return docs.sparkSession.read.schema(shards.schema).parquet(path)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``query_id, part, terms``: distinct word hashes in order."""
    def terms(batches):
        for batch in batches:
            out = []
            keys = batch.column(1).to_pylist()
            for pack in kernels.packs(batch.column(0)):
                w = kernels.words(pack)
                h = kernels.word_hashes(pack, w, lower=True)
                out += [(keys[pack.first + i], np.unique(h[w.first[i]:w.first[i + 1]]).tobytes()) for i in range(pack.n)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary()))],
                                                 names=["query_id", "terms"])

    return staged(queries.filter(F.col(id_col).isNotNull())
                  .select(F.col(text_col).cast("string").alias("_t"), F.col(id_col).cast("long").alias("_id"))
                  .mapInArrow(terms, "query_id long, terms binary"), "queries")


class Shard:
    """One shard in memory: lists of (document, contribution without idf)."""

    def __init__(self, row, mean: float):
        self.ids, lengths = _u(row[2], "<i8"), _u(row[3], "<i4").astype(float)
        self.terms, self.first = _u(row[4], "<u8"), _u(row[5], "<i8")
        self.docs, tf = _u(row[6], "<i4"), _u(row[7], "<i4")
        norm = K1 * (1 - B + B * lengths / mean) if mean else np.full(len(lengths), K1)
        self.worth = norm[self.docs]
        self.worth += tf
        np.divide(tf * (K1 + 1), self.worth, out=self.worth)
        self.sizes = np.diff(self.first)                        # of the lists; none is empty
        self.blocks = -(-len(self.ids) // BLOCK)

    def search(self, terms: np.ndarray, idf: np.ndarray, k: int, least: float = 0.0):
        """Top ``k`` (ids, scores) of a query of sorted ``terms``, of those
        that score ``least`` or more."""
        asked = Asked(self, terms, idf)
        _, ids, scores = asked.search(np.array([0, len(terms)]), np.arange(len(terms)), np.array([least]), k)
        return ids, scores


class Asked:
    """A shard for a block of queries over the sorted ``words``: the lists
    weighed by idf.

    Words in more than one of ``COMMON_SHARE`` documents are columns of a
    dense table in single precision, with the maximum of each block of
    documents; the others are lists that are added up per query.  Sums in
    single precision open blocks and choose documents, with ``SLACK`` for
    their rounding; chosen documents are scored in double precision."""

    def __init__(self, shard: Shard, words: np.ndarray, idf: np.ndarray):
        self.shard, n = shard, len(shard.ids)
        i = np.minimum(np.searchsorted(shard.terms, words), max(len(shard.terms) - 1, 0))
        has = shard.terms[i] == words if len(shard.terms) else np.zeros(len(words), bool)
        self.term = np.where(has, i, -1)                        # of each word
        weight = np.zeros(len(shard.terms))
        weight[i[has]] = idf[has]
        self.value = np.repeat(weight, shard.sizes)
        self.value *= shard.worth
        self.packed = np.empty(len(self.value), dtype=[("doc", np.int32), ("value", np.float32)])
        self.packed["doc"], self.packed["value"] = shard.docs, self.value
        self.packed = self.packed.view(np.int64)
        common = i[has & (shard.sizes[i] * COMMON_SHARE > n)] if len(shard.terms) else i[has]
        most = min(COMMON, TILE_BYTES // (4 * max(n, 1)))
        if len(common) > most:
            common = np.sort(common[np.argsort(-shard.sizes[common], kind="stable")[:most]])
        column = np.full(len(shard.terms) + 1, -1)
        column[common] = np.arange(len(common))
        self.column = column[self.term]                         # of each word: a column or none,
        self.list = np.where(self.column < 0, self.term, -1)    # a list or none
        self.dense = np.zeros((len(common), shard.blocks * BLOCK), np.float32)
        for c, (a, b) in enumerate(zip(shard.first[common].tolist(), shard.first[common + 1].tolist())):
            self.dense[c, shard.docs[a:b]] = self.value[a:b]
        self.most = self.dense.reshape(len(common), shard.blocks, BLOCK).max(axis=2)
        self.term_of = None
        self.room = -1

    def _at(self, lists: np.ndarray) -> np.ndarray:
        """Places of the postings of ``lists`` (good until the next call)."""
        sizes, first = self.shard.sizes[lists], self.shard.first[lists]
        end = np.cumsum(sizes)
        total = int(end[-1]) if len(end) else 0
        if total > self.room:
            self.room = 2 * total
            self.step, self.at, self.got, self.doc = (np.zeros(self.room, np.int64) for _ in range(4))
            self.add = np.zeros(self.room)
        step = self.step[:total]
        step.fill(1)
        step[:1] = first[:1]
        step[end[:-1]] = first[1:] - (first[:-1] + sizes[:-1] - 1)
        return np.cumsum(step, out=self.at[:total])

    def _sum(self, lists: np.ndarray) -> np.ndarray:
        """Sum of ``lists`` per document, rounded to single precision before."""
        at = self._at(lists)
        got, doc, add = self.got[:len(at)], self.doc[:len(at)], self.add[:len(at)]
        np.take(self.packed, at, out=got, mode="clip")
        doc[:], add[:] = got.view(np.int32)[0::2], got.view(np.float32)[1::2]
        return np.bincount(doc, weights=add, minlength=self.dense.shape[1])

    def _exact(self, lists, query: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Scores of pairs of a query and a document, sorted by query, each
        added up in the order of the words."""
        n, docs, out = len(self.shard.ids), self.shard.docs, np.empty(len(doc))
        if self.term_of is None:
            self.term_of = np.repeat(np.arange(len(self.shard.sizes), dtype=np.int32), self.shard.sizes)
        asked = np.zeros(n, bool)
        asked[doc] = True
        at = np.flatnonzero(asked[docs])                        # the postings of these documents
        mine = docs[at].astype(np.uint16) if n <= 1 << 16 else docs[at]
        at = at[np.argsort(mine, kind="stable")]                # by document, then word
        size = np.bincount(mine, minlength=n)
        begin = np.cumsum(size) - size
        term, value = self.term_of[at], self.value[at]
        wanted = np.zeros(len(self.shard.sizes), bool)
        heads = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        for a, b in zip(heads, np.append(heads[1:], len(query))):
            mine, part = lists(query[a]), doc[a:b]
            if b - a > FEW:                                     # so many that all documents cost less
                at = self._at(mine)
                out[a:b] = np.bincount(docs[at], weights=self.value[at], minlength=n)[part]
                continue
            wanted[mine] = True
            end = np.cumsum(size[part])
            place = np.arange(end[-1]) + np.repeat(begin[part] - (end - size[part]), size[part])
            has = wanted[term[place]]
            out[a:b] = np.bincount(np.repeat(np.arange(b - a), size[part])[has], weights=value[place[has]], minlength=b - a)
            wanted[mine] = False
        return out

    def _best(self, lists, query: np.ndarray, docs: np.ndarray, least: np.ndarray, k: int):
        """Query, id and score of the best ``k`` documents of each query."""
        s = np.round(self._exact(lists, query, docs), 9)
        ids = self.shard.ids[docs]
        order = np.lexsort((ids, -s, query))
        order = order[s[order] >= least[query[order]]]
        order = order[np.arange(len(order)) - np.searchsorted(query[order], query[order]) < k]
        return query[order], ids[order], s[order]

    def search(self, first: np.ndarray, words: np.ndarray, least: np.ndarray, k: int):
        """Top ``k`` (query, ids, scores) of queries whose words are ``words``
        between neighbours of ``first``, of those that score ``least`` or more."""
        def lists(query):
            x = self.term[words[first[query]:first[query + 1]]]
            return x[x >= 0]

        n, width = len(first) - 1, self.dense.shape[1]
        rows = max(1, min(TILE, n, TILE_BYTES // (4 * max(width, 1))))
        self.sums = np.empty((rows, width), np.float32)
        self.room_dense, self.room_scores = np.empty(self.dense.size, np.float32), np.empty(rows * RUN * BLOCK, np.float32)
        found, held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], [], 0
        for group in range(0, n, GROUP * rows):
            end = min(group + GROUP * rows, n)
            column = self.column[words[first[group]:first[end]]]
            column = np.bincount(column[column >= 0], minlength=len(self.dense)) > 0
            used, place = np.flatnonzero(column), np.cumsum(column) - 1
            dense = np.take(self.dense, used, axis=0, mode="clip",
                            out=self.room_dense[:len(used) * width].reshape(len(used), width))
            most = self.most[used]
            for a in range(group, end, rows):
                b = min(a + rows, end)
                query, docs = self._tile([words[x:y] for x, y in zip(first[a:b], first[a + 1:b + 1])],
                                         place, dense, most, least[a:b], k)
                held.append((a + query, docs))
                size += len(query)
                if size and (size >= PAIRS or b == n):
                    found.append(self._best(lists, *(np.concatenate(x) for x in zip(*held)), least, k))
                    held, size = [], 0
        return tuple(np.concatenate(x) for x in zip(*found))

    def _tile(self, queries: list, place, dense, most, least: np.ndarray, k: int):
        """(query, document) pairs that may be among the best ``k``."""
        sums, blocks = self.sums[:len(queries)], self.shard.blocks
        wanted = np.zeros((len(queries), len(dense)), np.float32)
        for j, words in enumerate(queries):
            column, lists = self.column[words], self.list[words]
            wanted[j, place[column[column >= 0]]] = 1
            sums[j] = self._sum(lists[lists >= 0])
        bound = (sums.reshape(len(queries), blocks, BLOCK).max(axis=2) + wanted @ most) * (1 + SLACK)
        floor = least.astype(float)
        got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]

        def lowest(floor):
            return np.maximum((floor - 1e-6) * (1 - SLACK), 1e-30).astype(np.float32)

        def open_(which):
            """Score the blocks ``which``; keep what may reach the floor."""
            cut = np.flatnonzero(np.diff(which.astype(np.int8), prepend=0, append=0))
            for a, b in ((x, min(x + RUN, end)) for x0, end in zip(cut[::2], cut[1::2]) for x in range(x0, end, RUN)):
                docs = slice(a * BLOCK, b * BLOCK)
                s = self.room_scores[:len(queries) * (b - a) * BLOCK].reshape(len(queries), -1)
                np.matmul(wanted, dense[:, docs], out=s)
                s += sums[:, docs]
                low = lowest(floor)
                rows = np.flatnonzero(s.max(axis=1) >= low)
                s = s[rows]
                hits = s >= low[rows, None]
                many = np.flatnonzero(hits.sum(axis=1) > k)
                if len(many):                                  # the floor rises with every run
                    kth = np.partition(s[many], -k, axis=1)[:, -k]
                    floor[rows[many]] = np.maximum(floor[rows[many]], kth * (1 - SLACK))
                    hits[many] &= s[many] >= lowest(floor[rows[many]])[:, None]
                at = np.flatnonzero(hits)
                if len(at):
                    r, d = np.divmod(at, s.shape[1])
                    got.append((rows[r], docs.start + d, s.ravel()[at]))

        todo = np.ones(blocks, bool)
        if blocks > FIRST_BLOCKS and (least <= 0).any():
            some = np.zeros(blocks, bool)
            some[np.argpartition(-bound.sum(axis=0), FIRST_BLOCKS - 1)[:FIRST_BLOCKS]] = True
            open_(some)
            todo = ~some
        open_(todo & (bound > np.maximum(floor - 1e-6, 0)[:, None]).any(axis=0))
        query, docs, scores = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((-scores, query))
        query, docs, scores = query[order], docs[order], scores[order]
        head = np.searchsorted(query, np.arange(len(queries) + 1))
        full = np.flatnonzero(np.diff(head) >= k)
        floor[full] = np.maximum(floor[full], scores[head[full] + k - 1] * (1 - SLACK))
        keep = scores >= lowest(floor)[query]
        return query[keep], docs[keep]


def _blocks(queries: DataFrame):
    """Blocks of queries (first number, ids, term arrays) of bounded size, in
    id order."""
    start, ids, terms, size = 0, [], [], 0
    for r in queries.orderBy("query_id", "terms").toLocalIterator(prefetchPartitions=False):
        ids.append(r[0])
        terms.append(np.frombuffer(bytes(r[1]), np.uint64))
        size += len(r[1])
        if len(ids) >= QUERY_BLOCK or size >= QUERY_BYTES:
            yield start, ids, terms
            start, ids, terms, size = start + len(ids), [], [], 0
    if ids:
        yield start, ids, terms


def _frequencies(shards: DataFrame, words: np.ndarray) -> np.ndarray:
    """Documents that hold each of ``words`` (sorted), over all shards."""
    asked = shards.sparkSession.sparkContext.broadcast(words)

    def count(batches):
        total = np.zeros(len(asked.value), dtype=np.int64)
        for batch in batches:
            for t, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t, df = _u(t, "<u8"), np.diff(_u(first, "<i8"))
                i = np.minimum(np.searchsorted(t, asked.value), max(len(t) - 1, 0))
                if len(t):
                    total += np.where(t[i] == asked.value, df[i], 0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["word", "df"])

    counted = (shards.select("terms", "first").mapInArrow(count, "word long, df long")
               .groupBy("word").agg(F.sum("df").alias("df")).toArrow())          # at most the block's words
    df = np.zeros(len(words))
    df[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    asked.unpersist()
    return df


def _search(shards: DataFrame, block, mean: float, k: int) -> DataFrame:
    """The block's queries in every shard."""
    def search(batches):
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(8))):
                numbers, ids, words, idf, first, asked, least = block.value
                q, d, s = Asked(Shard(row, mean), words, idf).search(first, asked, least, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[q]), pa.array(ids[q]), pa.array(d, mask=d == NO_ID), pa.array(s)],
                    names=["number", "query_id", "doc_id", "score"])

    return shards.mapInArrow(search, "number long, query_id long, doc_id long, score double")


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25_search(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``query_id, rank, doc_id, score`` of the best ``k`` documents for
    every row of ``queries``."""
    spark = docs.sparkSession
    shards = build_shards(docs, id_col, text_col)
    n_docs, n_words = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    mean = n_words / n_docs if n_docs else 0.0
    found = None
    for start, ids, terms in _blocks(query_terms(queries, id_col, text_col)):
        words, asked = np.unique(np.concatenate(terms), return_inverse=True)
        df = _frequencies(shards, words)
        idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        # neighbours alike: by the most frequent word
        first = np.append(0, np.cumsum([len(t) for t in terms]))
        places = [asked[a:b].astype(np.int32) for a, b in zip(first, first[1:])]
        order = np.argsort([p[np.argmax(df[p])] if len(p) else -1 for p in places], kind="stable")
        first, asked = np.append(0, np.cumsum(np.diff(first)[order])), np.concatenate([places[i] for i in order])
        numbers, ids, least = start + order, np.array(ids, np.int64)[order], np.zeros(len(ids))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        turn, top = 0, None
        for end in ROUNDS:
            block = spark.sparkContext.broadcast((numbers, ids, words, idf, first, asked, least))
            some = shards.filter(F.col("turn").between(turn, end - 1)).drop("turn")
            hits = _search(some, block, mean, k)
            top = staged(_best(hits if top is None else hits.unionByName(top), k), "top")
            block.unpersist()
            if end < ROUNDS[-1]:
                for r in top.filter(F.col("rank") == k).select("number", "score").collect():   # at most the block
                    least[place[r[0] - start]] = r[1]
                top = top.drop("rank")
            turn = end
        found = top if found is None else found.unionByName(top)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def op7_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 100, as a query, against all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bm25_search(docs, docs.filter("doc_id % 100 = 0"))


OP7_SQL = f"""
WITH w AS (
  SELECT doc_id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word FROM documents)
),
tf AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY ALL),
len AS (SELECT doc_id, count(*) AS len FROM w GROUP BY ALL),
n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM w) AS words),
idf AS (SELECT word, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, n GROUP BY word, n),
s AS (
  SELECT q.doc_id AS query_id, tf.doc_id,
         round(sum(idf * (tf.tf * {K1 + 1} / (tf.tf + {K1} * ({1 - B} + {B} * len.len / (words / n))))), 9) AS score
  FROM tf AS q JOIN tf USING (word) JOIN idf USING (word) JOIN len ON len.doc_id = tf.doc_id, n
  WHERE q.doc_id % 100 = 0
  GROUP BY ALL
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank,
       doc_id, round(score, 6) AS score
FROM s
QUALIFY rank <= {K}
"""
