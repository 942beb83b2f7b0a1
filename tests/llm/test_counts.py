"""Token counts through the digest cache, against direct encoding."""

import sentencepiece
from tokenizers import Tokenizer

from glossa.llm import op13_counts as counts
from glossa.llm.spread import attach
from glossa.llm.stages import stage_path
from glossa.llm.tokens import tokenizer_path
from llm_corpus import SF, empty, texts

PIECES, WORDS = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("word_bpe_49k.json")


def plain(path, rows):
    if path.endswith(".model"):
        n = [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t or "")) for _, t in rows]
    else:
        tok = Tokenizer.from_file(path)
        n = [len(tok.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    return sorted([(k, len((t or "").encode()), c) for (k, t), c in zip(rows, n)], key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_tokens").collect()), key=repr)


def test_counts_equal_direct_encoding(spark, stored):
    for path in (PIECES, WORDS):
        assert result(counts.count_tokens(stored, path, stage_path(spark, "cache"))) == plain(path, texts())


def test_known_digests_are_not_encoded_again(spark, stored, monkeypatch):
    cache = stage_path(spark, "cache")
    half = stored.filter("doc_id % 2 = 0 or doc_id is null")
    counts.count_tokens(half, PIECES, cache).count()
    version = counts.tokenizer_version(PIECES)
    before = counts.cached_counts(spark, cache, version)
    stored_rows = spark.read.parquet(f"{cache}/tokenizer={version}").count()
    assert before.count() == stored_rows == half.selectExpr("coalesce(text, '') as t").distinct().count()
    seen = []
    encode = counts.encode_misses
    monkeypatch.setattr(counts, "encode_misses", lambda t, p: seen.append(t.count()) or encode(t, p))
    assert result(counts.count_tokens(stored, PIECES, cache)) == plain(PIECES, texts())
    all_texts = stored.selectExpr("coalesce(text, '') as t").distinct()
    assert seen == [all_texts.count() - stored_rows]
    assert result(counts.count_tokens(stored, PIECES, cache)) == plain(PIECES, texts())
    assert seen[1:] == [0]
    # another tokenizer never meets these counts
    assert counts.tokenizer_version(WORDS) != version
    assert result(counts.count_tokens(stored, WORDS, cache)) == plain(WORDS, texts())


def test_wrong_counts_in_the_cache_are_what_is_returned(spark, stored):
    """The result comes from the cache, not from a second encoding."""
    cache = stage_path(spark, "cache")
    version = counts.tokenizer_version(PIECES)
    stored.selectExpr("unhex(sha2(coalesce(text, ''), 256)) as digest", "7L as n_tokens").distinct() \
        .write.parquet(f"{cache}/tokenizer={version}")
    assert {r[2] for r in result(counts.count_tokens(stored, PIECES, cache))} == {7}


def test_empty_table(spark):
    assert counts.count_tokens(empty(spark), PIECES, stage_path(spark, "cache")).count() == 0


def test_query(spark):
    import pyarrow.parquet as pq
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    df = counts.op13_token_counts(spark, SF)
    assert result(df) == plain(PIECES, rows)
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in df.collect())


def test_attach_splits_hot_groups(spark):
    rows = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 'hot' else cast(id as string) end as k")
    groups = rows.groupBy("k").count().selectExpr("k", "count as n", "length(k) as v")
    got = attach(rows, groups, "k", "n", 5000)
    assert sorted(got.columns) == ["id", "k", "v"]
    assert got.count() == 5000 and got.filter("v <> length(k)").count() == 0
