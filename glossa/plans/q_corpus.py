"""Corpus queries over F1 (documents; language = lang, source 'a' when the
number in ``source`` is even, else 'b'; language order de, en, es, fr):
A1, A2, A12-A15, P6, P7, C1-C8, L1-L3, L6, W4, W5, T1."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import text as tx
from glossa.operators import chunking, corpus
from glossa.plans.fixtures import with_ctes
from glossa.plans.registry import query
from glossa.session import materialize
from glossa.sources.tables import table

LANGS = ("de", "en", "es", "fr")      # F1 language order
SEED = 42
VAL_FRACTION = 0.05


def f1(spark, sf_dir):
    d = table(spark, sf_dir, "documents", spread=True)
    num = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    return d.select("doc_id", "text", F.col("lang").alias("language"),
                    F.when(num % 2 == 0, F.lit("a")).otherwise(F.lit("b")).alias("source"))


F1_SQL = r"""
f1 AS (SELECT doc_id, text, lang AS language,
              CASE WHEN CAST(regexp_extract(source, '(\d+)', 1) AS INTEGER) % 2 = 0
                   THEN 'a' ELSE 'b' END AS source
       FROM documents),
tok AS (SELECT *, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda t: t <> '') AS toks
        FROM f1)"""


def _pieces_sql(keys: str, name: str) -> str:
    """Pieces of every document with its merge batch inside ``keys``."""
    return f"""
{name}_b AS (SELECT *, (row_number() OVER (PARTITION BY {keys} ORDER BY
                        ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT) - 1) // 2000 AS batch,
                    len(toks) AS n, (len(toks) + 509) // 510 AS ns FROM tok),
{name}_p AS (SELECT doc_id, language, source, batch, toks, n,
                    CASE WHEN n > 510 THEN (n + ns - 1) // ns ELSE n END AS plen FROM {name}_b),
{name}_s AS (SELECT doc_id, language, source, batch, toks, plen,
                    unnest(CASE WHEN n > 510 THEN generate_series(0, n - 1, plen) ELSE [0] END) AS start
             FROM {name}_p),
{name} AS (SELECT doc_id, CAST(CASE WHEN plen = 0 THEN 0 ELSE start // plen END AS INTEGER) AS piece,
                  language, source, batch,
                  len(list_slice(toks, start + 1, start + plen)) AS n_tok,
                  array_to_string(list_slice(toks, start + 1, start + plen), ' ') AS ptext
           FROM {name}_s)"""


def _fold_sql(keys: list[str], name: str, src: str) -> str:
    """The greedy merge of short pieces as a recursive CTE (state: open
    buffer length and chunk counter; a piece joins the open chunk)."""
    k = ", ".join(keys)
    on = " AND ".join(f"s.{c} = r.{c}" for c in keys + ["batch"])
    over = "CASE WHEN r.buf > 0 AND r.buf + s.n_tok > 510 THEN 1 ELSE 0 END"
    mid = f"(CASE WHEN r.buf > 0 AND r.buf + s.n_tok > 510 THEN 0 ELSE r.buf END + s.n_tok)"
    rk = ", ".join(f"r.{c}" for c in keys)
    sk = ", ".join(f"s.{c}" for c in keys)
    eq = " AND ".join(f"f.{c} = s.{c}" for c in keys + ["batch"])
    return f"""
{name}_sh AS (SELECT *, row_number() OVER (PARTITION BY {k}, batch ORDER BY doc_id, piece) AS i
              FROM {src} WHERE n_tok < 250),
{name}_r({k}, batch, i, buf, cur, assigned) AS (
    SELECT {k}, batch, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(-1 AS BIGINT)
    FROM (SELECT DISTINCT {k}, batch FROM {name}_sh)
    UNION ALL
    SELECT {rk}, r.batch, r.i + 1,
           CASE WHEN {mid} >= 250 THEN 0 ELSE {mid} END,
           r.cur + {over} + CASE WHEN {mid} >= 250 THEN 1 ELSE 0 END,
           r.cur + {over}
    FROM {name}_r r JOIN {name}_sh s ON {on} AND s.i = r.i + 1),
{name} AS (SELECT arg_min(s.doc_id, s.i) AS doc_id, arg_min(s.piece, s.i) AS piece,
                  arg_max(s.language, s.i) AS language,
                  array_to_string(list_sort(list_distinct(list(s.source))), ',') AS source,
                  CAST(sum(s.n_tok) AS INTEGER) AS n_tokens,
                  CAST(count(*) AS INTEGER) AS n_fragments,
                  string_agg(s.ptext, ' ' ORDER BY s.i) AS text
           FROM {name}_sh s JOIN {name}_r f ON {eq} AND f.i = s.i
           GROUP BY {sk}, s.batch, f.assigned HAVING sum(s.n_tok) > 0)"""


def _chunks_sql(keys: list[str], name: str) -> str:
    return (_pieces_sql(", ".join(keys), f"{name}_pc") + "," + _fold_sql(keys, f"{name}_m", f"{name}_pc")
            + f""",
{name} AS (SELECT doc_id, piece, language, source, CAST(n_tok AS INTEGER) AS n_tokens,
                  1 AS n_fragments, ptext AS text FROM {name}_pc WHERE n_tok >= 250
           UNION ALL
           SELECT doc_id, piece, language, source, n_tokens, n_fragments, text FROM {name}_m)""")


# chunks built per (language, source) and per language (sources merged)
CHUNKS_SQL = _chunks_sql(["language", "source"], "ch")
CHUNKS_LANG_SQL = _chunks_sql(["language"], "chl")


def _chunks(spark, sf_dir, keys=("language", "source")):
    return chunking.smart_chunk(f1(spark, sf_dir), list(keys))


@query("lang_counts", with_ctes(F1_SQL, body="""
SELECT language, CAST(count(*) AS BIGINT) AS n FROM f1 GROUP BY language"""))
def lang_counts(spark, sf_dir):
    return corpus.language_counts(f1(spark, sf_dir)).select(
        "language", F.col("n").cast("long").alias("n"))


@query("balance_target", with_ctes(F1_SQL, body="""
SELECT CAST(min(n) AS BIGINT) AS min_count, CAST(count(*) AS BIGINT) AS n_languages
FROM (SELECT language, count(*) AS n FROM f1 GROUP BY language)"""))
def balance_target(spark, sf_dir):
    c = corpus.language_counts(f1(spark, sf_dir))
    return c.agg(F.min("n").cast("long").alias("min_count"),
                 F.count(F.lit(1)).cast("long").alias("n_languages"))


@query("token_counts", with_ctes(F1_SQL, body="""
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens FROM tok"""))
def token_counts(spark, sf_dir):
    return f1(spark, sf_dir).select("doc_id", tx.token_count("text").cast("long").alias("n_tokens"))


@query("truncate_512", with_ctes(F1_SQL, body="""
SELECT doc_id, CAST(least(len(toks), 510) AS BIGINT) AS n_tokens,
       md5(array_to_string(list_slice(toks, 1, 510), ' ')) AS text_md5 FROM tok"""))
def truncate_512(spark, sf_dir):
    t = tx.truncate_tokens("text", chunking.TARGET_MAX)
    return f1(spark, sf_dir).select(
        "doc_id", tx.token_count(t).cast("long").alias("n_tokens"), F.md5(t).alias("text_md5"))


@query("split_long", with_ctes(F1_SQL, _pieces_sql("language, source", "pc"), body="""
SELECT doc_id, CAST(piece AS BIGINT) AS piece, CAST(n_tok AS BIGINT) AS n_tokens, md5(ptext) AS text_md5
FROM pc WHERE doc_id IN (SELECT doc_id FROM tok WHERE len(toks) > 510)"""))
def split_long(spark, sf_dir):
    docs = f1(spark, sf_dir).filter(tx.token_count("text") > chunking.TARGET_MAX)
    p = chunking.split_long(docs)
    return p.select("doc_id", F.col("piece").cast("long").alias("piece"),
                    F.col("n_tokens").cast("long").alias("n_tokens"), F.md5("text").alias("text_md5"))


# P6 + C1: pieces are tokenised again and end where the model would (400
# tokens with the two special ones).
@query("split_model_max", with_ctes(F1_SQL, _pieces_sql("language, source", "pc"), body="""
SELECT doc_id, CAST(piece AS BIGINT) AS piece, CAST(least(n_tok, 398) AS BIGINT) AS n_tokens,
       md5(array_to_string(list_slice(string_split(ptext, ' '), 1, 398), ' ')) AS text_md5
FROM pc WHERE n_tok > 0"""))
def split_model_max(spark, sf_dir):
    p = chunking.split_long(f1(spark, sf_dir), model_max=400)
    return p.filter("n_tokens > 0").select("doc_id", F.col("piece").cast("long").alias("piece"),
                                           F.col("n_tokens").cast("long").alias("n_tokens"), F.md5("text").alias("text_md5"))


# U2 + C1 with the public byte-level subword vocabulary: pieces of at most
# 510 tokens are slices of the text, joined they are the text again.
@query("split_subwords", """
SELECT doc_id, md5(coalesce(text, '')) AS text_md5, true AS within_limit FROM documents""")
def split_subwords(spark, sf_dir):
    import public_tokenizers
    from glossa.operators.encoder import FileSpans
    spans = FileSpans(public_tokenizers.path("byte_bpe_50k.json"))
    p = chunking.split_spans(f1(spark, sf_dir).select("doc_id", "text"), spans)
    return p.groupBy("doc_id").agg(
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), ""))
        .alias("text_md5"), (F.max("n_tokens") <= chunking.TARGET_MAX).alias("within_limit"))


# White-space tokens as spans of the text, taken back as text.
@query("token_spans", with_ctes(F1_SQL, body="""
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5,
       coalesce(toks[3], '') AS third FROM tok"""))
def token_spans(spark, sf_dir):
    from glossa.operators import encoder
    t = encoder.token_spans(f1(spark, sf_dir).select("doc_id", "text"), words_col="words")
    return t.select("doc_id", F.size("spans").cast("long").alias("n_tokens"),
                    F.md5(F.array_join("words", " ")).alias("tokens_md5"),
                    encoder.span_text("text", "spans", 2, 1).alias("third"))


def _chunk_out(df):
    return df.select("doc_id", F.col("piece").cast("long").alias("piece"), "language", "source",
                     F.col("n_tokens").cast("long").alias("n_tokens"),
                     F.col("n_fragments").cast("long").alias("n_fragments"),
                     F.md5("text").alias("text_md5"))


CHUNK_OUT_SQL = """SELECT doc_id, CAST(piece AS BIGINT) AS piece, language, source,
       CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_fragments AS BIGINT) AS n_fragments,
       md5(text) AS text_md5"""


@query("merge_short", with_ctes(F1_SQL, CHUNKS_SQL, recursive=True, body=f"""
{CHUNK_OUT_SQL} FROM ch_m"""))
def merge_short(spark, sf_dir):
    return _chunk_out(chunking.merge_short(chunking.pieces_of(f1(spark, sf_dir)), ["language", "source"]))


@query("smart_chunk", with_ctes(F1_SQL, CHUNKS_SQL, recursive=True, body=f"""
{CHUNK_OUT_SQL} FROM ch"""))
def smart_chunk(spark, sf_dir):
    return _chunk_out(_chunks(spark, sf_dir))


# The chunk count of every language, sources chunked together.
@query("chunk_estimate", with_ctes(F1_SQL, CHUNKS_LANG_SQL, recursive=True, body="""
SELECT t.language, CAST(t.total_items AS BIGINT) AS total_items,
       CAST(coalesce(c.n, 0) AS BIGINT) AS estimated
FROM (SELECT language, count(*) AS total_items FROM f1 GROUP BY language) t
LEFT JOIN (SELECT language, count(*) AS n FROM chl GROUP BY language) c USING (language)"""))
def chunk_estimate(spark, sf_dir):
    e = chunking.chunk_estimate(f1(spark, sf_dir))
    return e.select("language", F.col("total_items").cast("long").alias("total_items"),
                    F.col("estimated").cast("long").alias("estimated"))


@query("source_counts", with_ctes(F1_SQL, CHUNKS_LANG_SQL, recursive=True, body="""
SELECT language, source, CAST(count(*) AS BIGINT) AS n
FROM (SELECT language, trim(unnest(string_split(source, ','))) AS source FROM chl)
GROUP BY language, source
UNION ALL
SELECT language, '_merged_fragments', CAST(count(*) FILTER (WHERE len(string_split(source, ',')) > 1) AS BIGINT)
FROM chl GROUP BY language"""))
def source_counts(spark, sf_dir):
    c = _chunks(spark, sf_dir, ["language"])
    return corpus.source_counts(c, ["language"]).select(
        "language", "source", F.col("n").cast("long").alias("n"))


@query("split_sources", with_ctes(F1_SQL, CHUNKS_LANG_SQL, recursive=True, body="""
SELECT doc_id, CAST(piece AS BIGINT) AS piece,
       CAST(len(string_split(source, ',')) AS BIGINT) AS n_sources,
       trim(string_split(source, ',')[1]) AS first_source FROM chl"""))
def split_sources(spark, sf_dir):
    c = _chunks(spark, sf_dir, ["language"])
    s = tx.split_sources("source")
    return c.select("doc_id", F.col("piece").cast("long").alias("piece"),
                    F.size(s).cast("long").alias("n_sources"), s[0].alias("first_source"))


QUOTA_SQL = f"""
avail AS (SELECT language, count(*) FILTER (WHERE source = 'a') AS available_a,
                 count(*) FILTER (WHERE source = 'b') AS available_b FROM ch GROUP BY language),
quota AS (SELECT min(available_a + available_b) AS m FROM avail),
quota_b AS (SELECT *, least(available_b, m - least(available_a, m // 2)) AS used_b FROM avail, quota),
quotas AS (SELECT language, available_a, available_b, least(available_a, m - used_b) AS used_a, used_b FROM quota_b),
ranked_src AS (SELECT c.*, row_number() OVER (PARTITION BY language, source
                 ORDER BY md5(CAST(doc_id AS VARCHAR) || '|' || CAST(piece AS VARCHAR) || ':{SEED}'), doc_id, piece) AS sp
               FROM ch c),
chosen AS (SELECT r.* FROM ranked_src r JOIN quotas q USING (language)
           WHERE r.sp <= CASE WHEN r.source = 'a' THEN q.used_a ELSE q.used_b END),
built AS (SELECT *, row_number() OVER (PARTITION BY language
                 ORDER BY md5(CAST(doc_id AS VARCHAR) || '|' || CAST(piece AS VARCHAR) || ':{SEED + 1}'), doc_id, piece) AS pos
          FROM chosen),
langs AS (SELECT * FROM (VALUES ('de', 0), ('en', 1), ('es', 2), ('fr', 3)) v(language, lang_ord)),
mc AS (SELECT min(n) AS min_count FROM (SELECT language, count(*) AS n FROM built GROUP BY language)),
sets AS (SELECT b.*, l.lang_ord, b.pos - 1 AS set_id FROM built b JOIN langs l USING (language), mc
         WHERE b.pos <= mc.min_count),
nsets AS (SELECT min_count AS n_sets,
                 CASE WHEN min_count - CAST(floor(min_count * 0.8) AS BIGINT) = 0 THEN min_count - 1
                      ELSE CAST(floor(min_count * 0.8) AS BIGINT) END AS train_sets FROM mc),
splitted AS (SELECT s.*, CASE WHEN s.set_id < n.train_sets THEN 'train' ELSE 'val' END AS split
             FROM sets s, nsets n)"""


def _built(spark, sf_dir):
    # the chunk table feeds several actions (counts, balance target, output):
    # write it once as a table in the shared checkpoint folder
    chunks = materialize(_chunks(spark, sf_dir), "chunks")
    return corpus.build_language(chunks, "a", "b", seed=SEED)


def _sets(spark, sf_dir):
    rows, quotas = _built(spark, sf_dir)
    sets, min_count = corpus.balance_and_interleave(rows, corpus.languages_table(spark, LANGS))
    return sets, quotas, min_count


@query("source_quota", with_ctes(F1_SQL, CHUNKS_SQL, QUOTA_SQL, recursive=True, body="""
SELECT language, CAST(available_a AS BIGINT) AS available_a, CAST(available_b AS BIGINT) AS available_b,
       CAST(used_a AS BIGINT) AS used_a, CAST(used_b AS BIGINT) AS used_b FROM quotas"""))
def source_quota(spark, sf_dir):
    q = corpus.source_quotas(_chunks(spark, sf_dir), "a", "b")
    return q.select("language", *[F.col(c).cast("long").alias(c) for c in
                                  ("available_a", "available_b", "used_a", "used_b")])


@query("quota_select", with_ctes(F1_SQL, CHUNKS_SQL, QUOTA_SQL, recursive=True, body="""
SELECT language, source, doc_id, CAST(piece AS BIGINT) AS piece FROM chosen"""))
def quota_select(spark, sf_dir):
    chunks = materialize(_chunks(spark, sf_dir).select("language", "source", "doc_id", "piece"), "chunks")
    q = corpus.source_quotas(chunks, "a", "b")
    sel = corpus.quota_select(chunks, q, "a", "b", seed=SEED)
    return sel.select("language", "source", "doc_id", F.col("piece").cast("long").alias("piece"))


@query("build_language", with_ctes(F1_SQL, CHUNKS_SQL, QUOTA_SQL, recursive=True, body="""
SELECT language, CAST(pos AS BIGINT) AS pos, doc_id, CAST(piece AS BIGINT) AS piece, source FROM built"""))
def build_language(spark, sf_dir):
    rows, _ = _built(spark, sf_dir)
    return rows.select("language", F.col("pos").cast("long").alias("pos"), "doc_id",
                       F.col("piece").cast("long").alias("piece"), "source")


@query("interleave_sets", with_ctes(F1_SQL, CHUNKS_SQL, QUOTA_SQL, recursive=True, body="""
SELECT CAST(set_id AS BIGINT) AS set_id, CAST(lang_ord AS BIGINT) AS lang_ord, language, doc_id,
       CAST(piece AS BIGINT) AS piece FROM sets"""))
def interleave_sets(spark, sf_dir):
    sets, _, _ = _sets(spark, sf_dir)
    return sets.select(F.col("set_id").cast("long").alias("set_id"),
                       F.col("lang_ord").cast("long").alias("lang_ord"), "language", "doc_id",
                       F.col("piece").cast("long").alias("piece"))


@query("set_split", with_ctes(F1_SQL, CHUNKS_SQL, QUOTA_SQL, recursive=True, body="""
SELECT split, CAST(count(DISTINCT set_id) AS BIGINT) AS n_sets, CAST(count(*) AS BIGINT) AS n_rows
FROM splitted GROUP BY split"""))
def set_split(spark, sf_dir):
    sets, _, _ = _sets(spark, sf_dir)
    return sets.groupBy("split").agg(F.count_distinct("set_id").cast("long").alias("n_sets"),
                                     F.count(F.lit(1)).cast("long").alias("n_rows"))


@query("source_rollup", with_ctes(F1_SQL, CHUNKS_SQL, QUOTA_SQL, recursive=True, body="""
SELECT coalesce(split, 'total') AS split, source, CAST(count(*) AS BIGINT) AS n
FROM (SELECT split, trim(unnest(string_split(source, ','))) AS source FROM splitted)
GROUP BY GROUPING SETS ((split, source), (source))"""))
def source_rollup(spark, sf_dir):
    sets, _, _ = _sets(spark, sf_dir)
    return corpus.source_rollup(sets).select("split", "source", F.col("n").cast("long").alias("n"))


@query("lang_accounting", with_ctes(F1_SQL, CHUNKS_SQL, QUOTA_SQL, recursive=True, body="""
SELECT q.language, CAST(q.available_a AS BIGINT) AS available_a, CAST(q.available_b AS BIGINT) AS available_b,
       CAST(q.available_a + q.available_b AS BIGINT) AS available_total,
       CAST(coalesce(f.fa, 0) AS BIGINT) AS used_a, CAST(coalesce(f.fb, 0) AS BIGINT) AS used_b,
       CAST(coalesce(f.ft, 0) AS BIGINT) AS used_total,
       CAST(greatest(0, q.available_a - coalesce(f.fa, 0)) AS BIGINT) AS unused_a,
       CAST(greatest(0, q.available_b - coalesce(f.fb, 0)) AS BIGINT) AS unused_b,
       CAST(coalesce(f.tr, 0) AS BIGINT) AS train, CAST(coalesce(f.va, 0) AS BIGINT) AS val,
       CAST(coalesce(f.tr, 0) + coalesce(f.va, 0) AS BIGINT) AS final_total,
       round(100.0 * coalesce(f.fa, 0) / greatest(coalesce(f.ft, 0), 1), 2) AS a_percent,
       round(100.0 * coalesce(f.fb, 0) / greatest(coalesce(f.ft, 0), 1), 2) AS b_percent
FROM quotas q LEFT JOIN (
  SELECT language, count(*) FILTER (WHERE contains(source, 'a')) AS fa,
         count(*) FILTER (WHERE contains(source, 'b')) AS fb, count(*) AS ft,
         count(*) FILTER (WHERE split = 'train') AS tr, count(*) FILTER (WHERE split = 'val') AS va
  FROM splitted GROUP BY language) f USING (language)"""))
def lang_accounting(spark, sf_dir):
    sets, quotas, _ = _sets(spark, sf_dir)
    acc = corpus.language_accounting(quotas, sets, "a", "b")
    longs = ["available_a", "available_b", "available_total", "used_a", "used_b", "used_total",
             "unused_a", "unused_b", "train", "val", "final_total"]
    return acc.select("language", *[F.col(c).cast("long").alias(c) for c in longs],
                      F.col("a_percent").cast("double"), F.col("b_percent").cast("double"))


@query("trim_to_min", with_ctes(F1_SQL, body=f"""
SELECT language, doc_id, CAST(pos AS BIGINT) AS pos FROM (
  SELECT language, doc_id, row_number() OVER (PARTITION BY language
         ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{SEED}'), doc_id) AS pos FROM f1)
WHERE pos <= (SELECT min(n) FROM (SELECT language, count(*) AS n FROM f1 GROUP BY language))"""))
def trim_to_min(spark, sf_dir):
    docs = f1(spark, sf_dir)
    ranked = corpus.seeded_rank(docs, ["language"], ["doc_id"], SEED, out_col="pos")
    m = corpus.balance_target(corpus.language_counts(docs), LANGS)
    return (ranked.filter(F.col("pos") <= m)
            .select("language", "doc_id", F.col("pos").cast("long").alias("pos")))


@query("exact_split", with_ctes(F1_SQL, body=f"""
SELECT doc_id, CASE WHEN r <= CAST(floor((SELECT count(*) FROM f1) * {VAL_FRACTION}) AS BIGINT)
                    THEN 'val' ELSE 'train' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{SEED}'), doc_id) AS r
      FROM f1)"""))
def exact_split(spark, sf_dir):
    s = corpus.exact_split(f1(spark, sf_dir), "doc_id", VAL_FRACTION, SEED)
    return s.select("doc_id", "split")


@query("replacement_sample", with_ctes(F1_SQL, body=f"""
SELECT CAST(d.i AS BIGINT) AS draw, f.doc_id, f.language
FROM (SELECT i, ('0x' || substr(md5('{SEED}:1:' || i), 1, 15))::BIGINT % (SELECT count(*) FROM f1) AS place
      FROM range((SELECT count(*) FROM f1)) t(i)) d
JOIN (SELECT doc_id, language, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM f1) f USING (place)"""))
def replacement_sample(spark, sf_dir):
    docs = f1(spark, sf_dir).select("doc_id", "language")
    return corpus.sample_with_replacement(docs, "doc_id", epoch=1, seed=SEED).select("draw", "doc_id", "language")


@query("seeded_order_first_n", with_ctes(F1_SQL, body=f"""
SELECT CAST(row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{SEED}'), doc_id) AS BIGINT) AS pos,
       doc_id FROM f1 ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{SEED}'), doc_id LIMIT 20"""))
def seeded_order_first_n(spark, sf_dir):
    # L1 with L2: a top-20 of the seeded order (the limit is the feature)
    docs = f1(spark, sf_dir).withColumn("_k", corpus.seeded_key("doc_id", SEED))
    top = docs.orderBy("_k", "doc_id").limit(20).select("doc_id", "_k")
    from pyspark.sql import Window
    return top.select(F.row_number().over(Window.orderBy("_k", "doc_id")).cast("long").alias("pos"),
                      "doc_id")


@query("union_sources", with_ctes(F1_SQL, body="""
SELECT language, source, CAST(count(*) AS BIGINT) AS n FROM
  (SELECT language, source FROM f1 WHERE source = 'a' UNION ALL
   SELECT language, source FROM f1 WHERE source = 'b') GROUP BY language, source"""))
def union_sources(spark, sf_dir):
    docs = f1(spark, sf_dir)
    u = docs.filter(F.col("source") == "a").unionByName(docs.filter(F.col("source") == "b"))
    return u.groupBy("language", "source").agg(F.count(F.lit(1)).cast("long").alias("n"))
