"""Reader and record-shape queries: S1-S9, J1, P1-P5, F2 (conversation
triples), F3 (web pages as passages) and F9 (line tables derived from the
tables in every shape the readers accept)."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import text as tx
from glossa.operators.ranking import row_number_scalable
from glossa.plans.fixtures import with_ctes
from glossa.plans.registry import query
from glossa.sources import readers
from glossa.sources.tables import table

# Fixed test model names (public checkpoints) for the prefix rules.
MODELS = ("intfloat/multilingual-e5-large", "Alibaba-NLP/gte-Qwen2-7B-instruct",
          "jinaai/jina-embeddings-v3", "google/embeddinggemma-300m",
          "nvidia/llama-nemotron-embed-1b-v2", "mixedbread-ai/mxbai-embed-large-v1",
          "BAAI/bge-m3")
MODELS_SQL = "[" + ", ".join(f"'{m}'" for m in MODELS) + "]"


# F2 --------------------------------------------------------------------------

def f2(spark, sf_dir):
    """(queries, collection, triples): user turns are queries, assistant
    turns passages; a triple is a user turn followed by an assistant turn,
    its negative the positive of the next pair; the last pair's negative and
    the queries of conversations with conv_id % 10 = 0 dangle."""
    c = table(spark, sf_dir, "conversations")
    tid = (F.col("conv_id") * 100 + F.col("turn")).cast("string")
    queries = c.filter(F.col("role") == "user").select(tid.alias("id"), "text")
    collection = c.filter(F.col("role") == "assistant").select(tid.alias("id"), "text")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn")
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"))
    pairs = u.join(a, ["conv_id", "turn"])
    ranked = row_number_scalable(pairs, [], ["conv_id", "turn"], out_col="rn")
    nxt = ranked.select((F.col("rn") - 1).alias("rn"),
                        (F.col("conv_id") * 100 + F.col("turn") + 1).cast("string").alias("nid"))
    trip = ranked.join(nxt, "rn", "left").select(
        "conv_id", "turn",
        F.when(F.col("conv_id") % 10 == 0,
               F.concat(F.lit("x"), (F.col("conv_id") * 100 + F.col("turn")).cast("string")))
        .otherwise((F.col("conv_id") * 100 + F.col("turn")).cast("string")).alias("qid"),
        (F.col("conv_id") * 100 + F.col("turn") + 1).cast("string").alias("pid"),
        F.coalesce(F.col("nid"), F.lit("999999999")).alias("nid"))
    return queries, collection, trip


F2_SQL = """
conv AS (SELECT * FROM conversations),
uq AS (SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS id, text FROM conv WHERE role = 'user'),
ac AS (SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS id, text FROM conv WHERE role = 'assistant'),
pairs AS (SELECT u.conv_id, u.turn FROM conv u JOIN conv a
          ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
          WHERE u.role = 'user'),
trip AS (SELECT conv_id, turn,
                CASE WHEN conv_id % 10 = 0 THEN 'x' || CAST(conv_id * 100 + turn AS VARCHAR)
                     ELSE CAST(conv_id * 100 + turn AS VARCHAR) END AS qid,
                CAST(conv_id * 100 + turn + 1 AS VARCHAR) AS pid,
                coalesce(lead(CAST(conv_id * 100 + turn + 1 AS VARCHAR)) OVER (ORDER BY conv_id, turn),
                         '999999999') AS nid
         FROM pairs)"""


@query("pair_text", with_ctes(F2_SQL, body="""
SELECT t.qid, t.pid, md5(q.text || chr(10) || p.text) AS text_md5
FROM trip t JOIN uq q ON q.id = t.qid JOIN ac p ON p.id = t.pid JOIN ac n ON n.id = t.nid"""))
def pair_text(spark, sf_dir):
    # J1 + P2: three inner joins resolve the ids; a dangling id drops the row
    queries, collection, trip = f2(spark, sf_dir)
    q = queries.withColumnRenamed("id", "qid").withColumnRenamed("text", "query")
    p = collection.withColumnRenamed("id", "pid").withColumnRenamed("text", "positive")
    n = collection.select(F.col("id").alias("nid"))
    res = trip.join(q, "qid").join(p, "pid").join(n, "nid")
    return res.select("qid", "pid", F.md5(tx.standardise_pair("query", "positive")).alias("text_md5"))


# S4 / S5 ------------------------------------------------------------------------

@query("lookup_last_wins", """
SELECT CAST(conv_id AS VARCHAR) AS id,
       arg_max(regexp_replace(regexp_replace(text, chr(10), ' ', 'g'), '\\s+$', ''), turn) AS text
FROM conversations WHERE role <> 'system' GROUP BY conv_id""")
def lookup_last_wins(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    line = F.when(F.col("role") == "system", F.concat(F.lit("sys"), F.col("conv_id").cast("string"))) \
        .otherwise(F.concat(F.col("conv_id").cast("string"), F.lit("\t"),
                            F.regexp_replace("text", "\n", " ")))
    lines = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("line_key"), line.alias("value"))
    return readers.parse_lookup(lines)


@query("triples_clean", with_ctes(F2_SQL, body="""
SELECT qid, pid, nid FROM trip WHERE conv_id % 7 <> 0 AND conv_id % 11 <> 0"""))
def triples_clean(spark, sf_dir):
    _, _, trip = f2(spark, sf_dir)
    line = (F.when(F.col("conv_id") % 7 == 0,
                   F.concat_ws("\t", "qid", "pid", "nid", F.lit("extra")))
            .when(F.col("conv_id") % 11 == 0, F.concat_ws("\t", "qid", "pid"))
            .otherwise(F.concat_ws("\t", "qid", "pid", "nid")))
    return readers.parse_triples(trip.select(line.alias("value")))


# S7 / S8 / S9 ----------------------------------------------------------------------

@query("queries_shapes", """
SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS qid, CASE WHEN turn % 4 = 2 THEN '{x} ' ELSE '' END || text AS text
FROM conversations WHERE role = 'user'""")
def queries_shapes(spark, sf_dir):
    # every second text begins like a JSON object; some lines are no JSON
    c = table(spark, sf_dir, "conversations").withColumn("text", F.concat(
        F.when(F.col("turn") % 4 == 2, F.lit("{x} ")).otherwise(F.lit("")), "text"))
    tid = (F.col("conv_id") * 100 + F.col("turn")).cast("string")
    shape = F.col("conv_id") % 3
    line = (F.when(F.col("role") != "user", F.when(F.col("turn") % 3 == 0, F.lit('{"q": bad')).otherwise(F.lit("")))
            .when(shape == 0, F.to_json(F.struct(tid.alias("_id"), F.col("text"))))
            .when(shape == 1, F.to_json(F.create_map(tid, F.col("text"))))
            .otherwise(F.to_json(F.create_map(tid, F.struct(F.col("text"))))))
    lines = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("line_key"), line.alias("value"))
    return readers.parse_queries(lines, malformed="skip")


@query("corpus_shapes", """
SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS doc_id,
       CASE WHEN turn % 4 = 1 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g')
            ELSE regexp_replace('T' || CAST(conv_id AS VARCHAR) || ' ' || text, '^\\s+|\\s+$', '', 'g')
       END AS text
FROM conversations WHERE role = 'assistant'""")
def corpus_shapes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    tid = (F.col("conv_id") * 100 + F.col("turn")).cast("string")
    title = F.when(F.col("turn") % 4 == 1, F.lit("")).otherwise(
        F.concat(F.lit("T"), F.col("conv_id").cast("string")))
    doc = F.struct(title.alias("title"), F.col("text"))
    line = (F.when(F.col("conv_id") % 2 == 0,
                   F.to_json(F.struct(tid.alias("_id"), title.alias("title"), F.col("text"))))
            .otherwise(F.to_json(F.create_map(tid, doc))))
    lines = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("line_key"), line.alias("value"))
    return readers.parse_corpus(lines).select("doc_id", "text")


@query("qrels_shapes", with_ctes(F2_SQL, body="""
SELECT qid, pid AS doc_id, CASE WHEN conv_id % 5 = 0 THEN 2 ELSE 1 END AS rel FROM trip
UNION ALL
SELECT qid, nid, 0 FROM trip WHERE nid <> pid"""))
def qrels_shapes(spark, sf_dir):
    _, _, trip = f2(spark, sf_dir)
    key = F.col("conv_id") * 100 + F.col("turn")
    flat_pos = F.to_json(F.struct(F.col("qid").alias("query-id"), F.col("pid").alias("corpus-id"),
                                  F.lit(1).alias("score")))
    flat_neg = F.to_json(F.struct(F.col("qid").alias("query-id"), F.col("nid").alias("corpus-id"),
                                  F.lit(0).alias("score")))
    nested = F.to_json(F.create_map(F.col("qid"), F.create_map(
        F.col("pid"), F.lit(1), F.col("nid"), F.lit(0))))
    even = F.col("conv_id") % 2 == 0
    lines = (trip.filter(even).select((key * 10).alias("line_key"), flat_pos.alias("value"))
             .unionByName(trip.filter(even).select((key * 10 + 1).alias("line_key"),
                                                   flat_neg.alias("value")))
             .unionByName(trip.filter(~even).select((key * 10).alias("line_key"),
                                                    nested.alias("value")))
             # a later line raises the positive of every fifth conversation
             .unionByName(trip.filter(F.col("conv_id") % 5 == 0).select(
                 (F.lit(10 ** 9) + key).alias("line_key"),
                 F.to_json(F.create_map(F.col("qid"), F.create_map(F.col("pid"), F.lit(2))))
                 .alias("value"))))
    return readers.parse_qrels(lines).select("qid", "doc_id", F.col("rel").cast("int").alias("rel"))


# S1 / S2 / S3 ------------------------------------------------------------------------

def _raw_lines(spark, sf_dir):
    """Object lines, array lines of an object and scalars, objects without
    text, blank lines and lines that are no JSON."""
    d = table(spark, sf_dir, "documents")
    k = d.doc_id % 3
    array = F.concat(F.lit("["), F.to_json(F.struct("text")), F.lit(", \""), F.col("lang"), F.lit("\", \"{"),
                     F.col("lang"), F.lit("} x\", null, true, 7]"))
    line = (F.when(k == 0, F.to_json(F.struct("text", F.col("lang").alias("language"))))
            .when(k == 1, array)
            .otherwise(F.to_json(F.struct(F.col("lang").alias("language")))))
    lines = d.select((F.col("doc_id") * 10).alias("line_key"), line.alias("value"))
    blank = d.filter(F.col("doc_id") % 5 == 0).select((F.col("doc_id") * 10 + 1).alias("line_key"), F.lit("  \u3000 ").alias("value"))
    bad = d.filter(F.col("doc_id") % 7 == 0).select(
        (F.col("doc_id") * 10 + 2).alias("line_key"),
        F.when(F.col("doc_id") % 2 == 0, F.lit("not json")).otherwise(F.lit("[bad")).alias("value"))
    return lines.unionByName(blank).unionByName(bad)


@query("raw_text", """
SELECT doc_id * 10 AS line_key, 0 AS item, md5(text) AS text_md5 FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id * 10, 0, md5('') FROM documents WHERE doc_id % 3 = 2
UNION ALL
SELECT doc_id * 10, i - 1, md5(list_extract([text, lang, '{' || lang || '} x', 'None', 'True', '7'], i))
FROM documents, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS i) WHERE doc_id % 3 = 1""")
def raw_text(spark, sf_dir):
    recs = readers.parse_text_records(_raw_lines(spark, sf_dir), "text", malformed="skip")
    return recs.select("line_key", F.col("item").cast("int").alias("item"),
                       F.md5("text").alias("text_md5"))


@query("raw_text_rejects", """
SELECT doc_id * 10 + 2 AS line_key, CASE WHEN doc_id % 2 = 0 THEN 'not json' ELSE '[bad' END AS value
FROM documents WHERE doc_id % 7 = 0""")
def raw_text_rejects(spark, sf_dir):
    return readers.rejects(_raw_lines(spark, sf_dir))


# Lines of the wrong shape are listed, the others are read.
SHAPES_SQL = """
SELECT doc_id AS line_key, CASE doc_id % 5 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN '["' || lang || '"]'
       WHEN 2 THEN 'null' WHEN 3 THEN '{"cut": ' ELSE '{"_id":"' || doc_id || '","text":"' || lang || '"}' END AS value
FROM documents"""


def _shape_lines(spark, sf_dir):
    d, key = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(key.alias("line_key"), F.when(key % 5 == 0, key.cast("string"))
                    .when(key % 5 == 1, F.concat(F.lit('["'), "lang", F.lit('"]'))).when(key % 5 == 2, F.lit("null"))
                    .when(key % 5 == 3, F.lit('{"cut": '))
                    .otherwise(F.to_json(F.struct(key.cast("string").alias("_id"), F.col("lang").alias("text")))).alias("value"))


@query("object_rejects", f"SELECT line_key, value FROM ({SHAPES_SQL}) WHERE line_key % 5 <> 4")
def object_rejects(spark, sf_dir):
    return readers.rejects(_shape_lines(spark, sf_dir), objects=True)


@query("queries_well_formed", "SELECT CAST(doc_id AS VARCHAR) AS qid, lang AS text FROM documents WHERE doc_id % 5 = 4")
def queries_well_formed(spark, sf_dir):
    return readers.parse_queries(_shape_lines(spark, sf_dir), malformed="skip")


@query("labelled_text", """
SELECT CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE lang END AS language,
       CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM documents WHERE doc_id % 11 <> 0 GROUP BY 1""")
def labelled_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    txt = F.when(F.col("doc_id") % 11 == 0, F.lit("")).otherwise(F.col("text"))
    obj = F.when(F.col("doc_id") % 7 == 0, F.to_json(F.struct(txt.alias("text")))) \
        .otherwise(F.to_json(F.struct(txt.alias("text"), F.col("lang").alias("language"))))
    lines = d.select(F.col("doc_id").alias("line_key"), obj.alias("value"))
    recs = readers.parse_labelled(lines, "text", "language", drop_empty=True)
    return recs.groupBy("language").agg(F.count(F.lit(1)).cast("long").alias("n"),
                                        F.sum(F.length("text")).cast("long").alias("n_chars"))


@query("plain_lines", """
SELECT doc_id, CAST(pos AS BIGINT) AS pos, md5(t) AS text_md5 FROM (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos,
         regexp_replace(unnest(string_split(text, chr(10))), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS t
  FROM documents) WHERE t <> ''""")
def plain_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    # ideographic and no-break spaces around the lines are stripped as well
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "value")) \
        .select(F.struct("doc_id", "pos").alias("line_key"),
                F.concat(F.lit("\u3000"), "value", F.lit(" \u00a0")).alias("value"))
    p = readers.parse_plain(lines)
    return p.select(F.col("line_key.doc_id").alias("doc_id"),
                    F.col("line_key.pos").cast("long").alias("pos"), F.md5("text").alias("text_md5"))


# F3 / P1 / P4 / P5 -------------------------------------------------------------------

def f3(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select(
        "page_id",
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.regexp_replace("html", "<[^>]*>", " ").alias("text"),
        F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("language"))


F3_SQL = """
f3 AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
              regexp_replace(html, '<[^>]*>', ' ', 'g') AS text,
              regexp_extract(html, '<html lang="([^"]*)"', 1) AS language FROM pages)"""


@query("passages", with_ctes(F3_SQL, body="""
SELECT page_id, language, md5(title) AS title_md5, CAST(length(text) AS BIGINT) AS n_chars FROM f3"""))
def passages(spark, sf_dir):
    return f3(spark, sf_dir).select("page_id", "language", F.md5("title").alias("title_md5"),
                                    F.length("text").cast("long").alias("n_chars"))


@query("passage_text", with_ctes(F3_SQL, body="""
SELECT page_id, language, md5(title || chr(10) || text) AS text_md5 FROM f3"""))
def passage_text(spark, sf_dir):
    f = f3(spark, sf_dir)
    return f.select("page_id", "language",
                    F.md5(tx.standardise_passage("title", "text")).alias("text_md5"))


@query("doc_text", with_ctes(F3_SQL, body="""
SELECT page_id, md5(CASE WHEN title <> '' THEN regexp_replace(title || ' ' || text, '^\\s+|\\s+$', '', 'g')
                         ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END) AS text_md5 FROM f3"""))
def doc_text(spark, sf_dir):
    f = f3(spark, sf_dir)
    return f.select("page_id", F.md5(tx.doc_text("title", "text")).alias("text_md5"))


def _prefix_sql(rules) -> str:
    """The rules as a SQL CASE over the model name ``m``."""
    def literal(text):
        return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))
    whens = []
    for (kind, needles), prefix in rules:
        test = [f"contains(lower(m), '{n}')" if kind == "contains" else f"m = '{n}'" for n in needles]
        whens.append(f"WHEN {' OR '.join(test)} THEN {literal(prefix)}")
    return f"CASE {' '.join(whens)} ELSE '' END"


QP_SQL, PP_SQL = _prefix_sql(tx.QUERY_PREFIX_RULES), _prefix_sql(tx.PASSAGE_PREFIX_RULES)


@query("query_prefix", f"""
SELECT doc_id, m AS model, md5({QP_SQL} || text) AS text_md5
FROM documents, (SELECT unnest({MODELS_SQL}) AS m)""")
def query_prefix(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    x = d.select("doc_id", "text", F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"))
    return x.select("doc_id", "model", F.md5(tx.with_query_prefix("text", "model")).alias("text_md5"))


@query("passage_prefix", with_ctes(F3_SQL, body=f"""
SELECT page_id, m AS model,
       md5(CASE WHEN {PP_SQL} <> '' THEN {PP_SQL} || text
                WHEN title <> '' THEN regexp_replace(title || ' ' || text, '^\\s+|\\s+$', '', 'g')
                ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END) AS text_md5
FROM f3, (SELECT unnest({MODELS_SQL}) AS m)"""))
def passage_prefix(spark, sf_dir):
    f = f3(spark, sf_dir)
    x = f.select("page_id", "title", "text",
                 F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"))
    return x.select("page_id", "model",
                    F.md5(tx.with_passage_prefix("title", "text", "model")).alias("text_md5"))
