from pyspark.sql import functions as F

from glossa.operators import chunking
from paths import SF_MID


def _docs(spark):
    from glossa.plans.q_corpus import f1
    return f1(spark, SF_MID)


def test_no_token_lost_and_limits(spark):
    docs = _docs(spark)
    chunks = chunking.smart_chunk(docs).cache()
    assert chunks.filter(F.col("n_tokens") > chunking.TARGET_MAX).count() == 0
    from glossa.functions.text import token_count
    total_in = docs.select(F.sum(token_count("text"))).first()[0]
    total_out = chunks.select(F.sum("n_tokens")).first()[0]
    assert total_in == total_out
    # every input document appears in exactly one chunk as a first fragment or
    # inside a merged one: tokens per language match
    per_lang_in = {r[0]: r[1] for r in docs.groupBy("language").agg(F.sum(token_count("text"))).collect()}
    per_lang_out = {r[0]: r[1] for r in chunks.groupBy("language").agg(F.sum("n_tokens")).collect()}
    assert per_lang_in == per_lang_out
    # at most one chunk shorter than the minimum per merge batch
    short = (chunks.filter(F.col("n_tokens") < chunking.TARGET_MIN)
             .groupBy("language", "source", "batch").count())
    assert short.filter(F.col("count") > 1).count() == 0


def test_overflow_flush_with_custom_limits(spark):
    # min 6, max 8: pieces of 5 tokens cannot share a buffer (5 + 5 > 8)
    rows = [(i, " ".join(["w"] * 5), "xx", "a") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, language string, source string")
    out = chunking.smart_chunk(docs, min_len=6, max_len=8).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_tokens"], r["n_fragments"]) for r in out] == \
        [(0, 5, 1), (1, 5, 1), (2, 5, 1), (3, 5, 1)]


def test_split_pieces(spark):
    docs = spark.createDataFrame([(1, " ".join(str(i) for i in range(1021)))], "doc_id long, text string")
    p = chunking.split_long(docs).orderBy("piece").collect()
    assert [r["n_tokens"] for r in p] == [341, 341, 339]
    assert " ".join(r["text"] for r in p) == docs.first()["text"]


def test_estimate_is_the_chunk_count(spark):
    docs = _docs(spark)
    got = {r["language"]: r["estimated"] for r in chunking.chunk_estimate(docs).collect()}
    want = {r[0]: r[1] for r in chunking.smart_chunk(docs, ["language"]).groupBy("language").count().collect()}
    assert got == want


def test_string_ids_and_another_tokenizer(spark):
    rows = [(f"d{i}#x", "aa-bb-cc", "xx", "a") for i in range(3)] + [("long", "-".join(["t"] * 25), "xx", "b")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, language string, source string")
    out = chunking.smart_chunk(docs, ["language"], min_len=6, max_len=10, tokenizer=lambda c: F.split(c, "-"))
    got = sorted((r["doc_id"], r["piece"], r["n_tokens"], r["source"]) for r in out.collect())
    assert got == [("d0#x", 0, 6, "a"), ("d2#x", 0, 3, "a"), ("long", 0, 9, "b"), ("long", 1, 9, "b"), ("long", 2, 7, "b")]


def test_pieces_are_cut_again_for_the_model(spark):
    # a tokenizer that sees twice as many tokens once a text was cut and joined by spaces
    def grows(c):
        return F.when(F.contains(c, F.lit(" ")), F.split(c, "")).otherwise(F.split(c, "-"))
    docs = spark.createDataFrame([(1, "-".join(["t"] * 30))], "doc_id long, text string")
    out = chunking.split_long(docs, max_len=10, tokenizer=grows, model_max=14).collect()
    assert [r["n_tokens"] for r in out] == [12, 12, 12]


def test_batches_split_equal_ids(spark):
    """20,000 rows of one id (the same row) fill ten batches, others around
    them keep theirs near 2,000."""
    same = spark.range(20_000).selectExpr("'hot' as doc_id", "'a b c' as text", "'xx' as language", "'s' as source")
    rest = spark.range(5_000).selectExpr("concat('d', id) as doc_id", "'a b' as text", "'xx' as language",
                                         "cast(null as string) as source")
    pieces = chunking.pieces_of(same.unionByName(rest))
    rows = chunking.with_batches(pieces, pieces.filter("piece = 0"), ["language", "source"])
    sizes = {(r["source"], r["batch"]): r["count"] for r in rows.groupBy("source", "batch").count().collect()}
    assert sorted(b for s, b in sizes if s == "s") == list(range(10))
    assert all(1700 < n < 2300 for (s, _), n in sizes.items() if s == "s")
    assert {(s, b): n for (s, b), n in sizes.items() if s is None} == {(None, 0): 2000, (None, 1): 2000, (None, 2): 1000}
    out = chunking.smart_chunk(same.unionByName(rest))
    assert out.agg(F.sum("n_tokens")).first()[0] == 20_000 * 3 + 5_000 * 2
    assert out.agg(F.max("n_fragments")).first()[0] <= 255


def test_texts_are_tokenised_once(spark, tmp_path):
    class Counting:
        """White-space spans, noting in a file how many texts were tokenised."""

        special_tokens = 2

        def __init__(self, path):
            self.path = path

        def __call__(self):
            from glossa.operators.encoder import WhiteSpaceSpans
            plain, path = WhiteSpaceSpans()(), self.path

            def spans(texts):
                with open(path, "a") as f:
                    f.write(f"{len(texts)}\n")
                return plain(texts)
            return spans

    path = str(tmp_path / "calls")
    docs = _docs(spark)
    out = chunking.smart_chunk(docs, spans=Counting(path))
    assert out.count() > 0 and out.filter("n_tokens < 250").count() > 0
    assert sum(map(int, open(path))) == docs.count()


def test_subword_pieces_are_slices(spark):
    import public_tokenizers
    from glossa.operators.encoder import FileSpans
    spans = FileSpans(public_tokenizers.path("byte_bpe_50k.json"))
    odd = "  lead \U0001f600\U0001f469\u200d\U0001f680 caf\u00e9 \u4f60\u597d\n\n tail  "
    rows = [(1, odd * 9, "xx", "a"), (2, "", "xx", "a"), (3, None, "xx", "b"), (4, "short one", "xx", "b"),
            (5, " another short", "xx", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, language string, source string")
    got = {}
    for r in chunking.split_spans(docs, spans, max_len=7).orderBy("piece").collect():
        assert r["n_tokens"] <= 7
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert {k: "".join(v) for k, v in got.items()} == {k: t or "" for k, t, _, _ in rows}
    assert len(got[1]) > 10
    merged = chunking.smart_chunk(docs.filter("doc_id > 3"), ["language"], min_len=8, max_len=12, spans=spans).collect()
    assert [(r["text"], r["source"], r["n_fragments"]) for r in merged] == [("short one another short", "a,b", 2)]
    # a model that takes 5 tokens with its 2 special ones
    cut = chunking.smart_chunk(docs.filter("doc_id = 1"), min_len=4, max_len=7, spans=spans, model_max=5).collect()
    count = spans()
    assert cut and all(len(count([r["text"]])[0]) <= 3 and r["n_tokens"] <= 3 for r in cut)
