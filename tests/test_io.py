"""Readers on real files (F9) and sink round trips (K1-K5)."""

import gzip
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from glossa.sources import readers, sinks


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="glossa-io-")


def _write(path, lines):
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_jsonl_shapes_and_first_n(spark, tmp):
    p = os.path.join(tmp, "corpus.jsonl")
    _write(p, ['{"text": "a", "language": "en"}', "", '[{"text": "b"}, "c"]', '{"other": 1}',
               '   ', '{"text": "d"}'])
    recs = readers.parse_text_records(readers.read_lines(spark, p))
    assert [r["text"] for r in recs.orderBy("line_key", "item").collect()] == ["a", "b", "c", "", "d"]
    assert [r["text"] for r in readers.first_n(recs, 2).collect()] == ["a", "b"]
    lab = readers.parse_labelled(readers.read_lines(spark, p), malformed="skip")     # the array line is a reject
    assert {(r["text"], r["language"]) for r in lab.collect()} == {("a", "en"), ("d", "unknown")}


def test_tsv_lookup_triples_and_plain(spark, tmp):
    p = os.path.join(tmp, "lookup.tsv")
    _write(p, ["1\tfirst", "2\ttwo", "bad line", "1\tlast  "])
    got = {r["id"]: r["text"] for r in readers.parse_lookup(readers.read_lines(spark, p)).collect()}
    assert got == {"1": "last", "2": "two"}
    t = os.path.join(tmp, "triples.tsv")
    _write(t, ["q\tp\tn", "q\tp", "q\tp\tn\tx"])
    assert readers.parse_triples(readers.read_lines(spark, t)).count() == 1
    pl = os.path.join(tmp, "plain.txt")
    _write(pl, ["  one ", "", "two"])
    assert [r["text"] for r in readers.parse_plain(readers.read_lines(spark, pl))
            .orderBy("line_key").collect()] == ["one", "two"]


def test_eval_shapes(spark, tmp):
    q = os.path.join(tmp, "queries.jsonl")
    _write(q, ['{"_id": "q1", "text": "x"}', '{"q2": "y"}', '{"q3": {"text": "z"}}'])
    got = {r["qid"]: r["text"] for r in readers.parse_queries(readers.read_lines(spark, q)).collect()}
    assert got == {"q1": "x", "q2": "y", "q3": "z"}
    c = os.path.join(tmp, "corpus.jsonl")
    _write(c, ['{"_id": "d1", "title": "T", "text": " body "}', '{"d2": {"text": "b2"}, "d3": {"title": "", "text": "b3"}}'])
    got = {r["doc_id"]: r["text"] for r in readers.parse_corpus(readers.read_lines(spark, c)).collect()}
    assert got == {"d1": "T  body", "d2": "b2", "d3": "b3"}
    r = os.path.join(tmp, "qrels.jsonl")
    _write(r, ['{"query-id": "q1", "corpus-id": "d1", "score": 1}', '{"q1": {"d2": 2}}', '{"q1": {"d1": 0}}'])
    got = {(x["qid"], x["doc_id"]): x["rel"] for x in readers.parse_qrels(readers.read_lines(spark, r)).collect()}
    assert got == {("q1", "d1"): 0, ("q1", "d2"): 2}


def test_passages_gz_and_missing(spark, tmp):
    d = os.path.join(tmp, "wiki")
    os.makedirs(d)
    for i in range(2):
        with gzip.open(os.path.join(d, f"docs-{i}.jsonl.gz"), "wt", encoding="utf-8") as f:
            f.write(json.dumps({"docid": f"{i}", "title": "t", "text": "x"}) + "\n")
    assert readers.read_passages(spark, f"{d}/*.jsonl.gz", num_partitions=2).count() == 2
    assert readers.read_passages(spark, f"{tmp}/nothing/*.gz").count() == 0


def test_sinks_round_trip(spark, tmp):
    df = spark.createDataFrame([(0, "a", "en", "x"), (1, "b", "fr", "y")],
                               "set_id long, text string, language string, source string")
    sinks.write_jsonl(df, os.path.join(tmp, "out"), order_within=["set_id"])
    assert spark.read.json(os.path.join(tmp, "out")).count() == 2
    atoms = spark.createDataFrame([(0, [1.0, 0.0], [1.0, 0.0]), (1, [0.0, 1.0], [0.0, 1.0])],
                                  "feature int, enc array<double>, dec array<double>")
    meta = {"input_dim": 2, "dict_size": 2, "expansion_factor": 1, "sparsity": 1}
    sinks.write_model(spark, atoms, meta, os.path.join(tmp, "model"))
    a2, m2 = sinks.read_model(spark, os.path.join(tmp, "model"))
    assert m2 == meta and a2.count() == 2
    with pytest.raises(ValueError):
        sinks.write_model(spark, atoms, {"input_dim": 2}, os.path.join(tmp, "m2"))
    res = spark.createDataFrame([("d1", 0.5, 0.9), ("d2", 0.5, 0.8)], "dataset string, threshold double, value double")
    path = os.path.join(tmp, "results")
    assert sinks.write_results(spark, res, path, ["dataset", "threshold"]).count() == 2
    again = sinks.write_results(spark, res, path, ["dataset", "threshold"])
    assert again.count() == 0
    assert spark.read.parquet(path).count() == 2
    sinks.write_embeddings(df.select("set_id", F.array(F.lit(1.0)).alias("embedding")),
                           os.path.join(tmp, "emb"))
    assert readers.read_embeddings(spark, os.path.join(tmp, "emb"), dim=1).count() == 2


def test_statistics_document(spark, tmp):
    from glossa.operators import corpus
    from glossa.plans.q_corpus import _sets
    from paths import SF_SMALL
    sets, quotas, _ = _sets(spark, SF_SMALL)
    acc = corpus.language_accounting(quotas, sets, "a", "b")
    doc = corpus.statistics(acc)
    sinks.write_statistics(doc, os.path.join(tmp, "stats"))
    back = spark.read.json(os.path.join(tmp, "stats")).collect()
    assert len(back) == 4
    parsed = json.loads(back[0]["statistics"])
    assert set(parsed) == {"available", "used", "unused", "final_dataset", "source_distribution"}
    assert parsed["final_dataset"]["total"] == parsed["final_dataset"]["train"] + parsed["final_dataset"]["val"]


def test_json_array_and_single_object(spark, tmp):
    p = os.path.join(tmp, "arr.json")
    with open(p, "w", encoding="utf-8") as f:
        json.dump([{"text": "a"}, {"text": "b"}, {"other": 1}], f, indent=2)
    got = sorted(r["text"] for r in readers.read_json_records(spark, p).collect())
    assert got == ["", "a", "b"]
    q = os.path.join(tmp, "one.json")
    with open(q, "w", encoding="utf-8") as f:
        json.dump({"text": "solo"}, f, indent=2)
    assert [r["text"] for r in readers.read_json_records(spark, q).collect()] == ["solo"]


def test_last_wins_follows_line_order_across_splits(spark, tmp):
    p = os.path.join(tmp, "big.tsv")
    lines = [f"{i % 50}\tv{i}" for i in range(20000)]
    _write(p, lines)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        src = readers.read_lines(spark, p)
        assert src.rdd.getNumPartitions() > 4
        got = {r["id"]: r["text"] for r in readers.parse_lookup(src).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {str(i % 50): f"v{i}" for i in range(20000)}
    assert got == want


def test_malformed_lines_fail_or_are_listed(spark):
    import pytest
    rows = ['["{a} b", null, true, 1.5]', "not json", '{"text": null}', "[bad"]
    lines = spark.createDataFrame(list(enumerate(rows)), "line_key long, value string")
    with pytest.raises(Exception, match="malformed JSON line: not json|malformed JSON line: \\[bad"):
        readers.parse_text_records(lines).collect()
    got = [r["text"] for r in readers.parse_text_records(lines, malformed="skip").orderBy("line_key", "item").collect()]
    assert got == ["{a} b", "None", "True", "1.5", ""]
    assert [r["value"] for r in readers.rejects(lines).orderBy("line_key").collect()] == ["not json", "[bad"]


def test_scalar_array_file_and_texts_like_objects(spark, tmp):
    p = os.path.join(tmp, "scalars.json")
    with open(p, "w", encoding="utf-8") as f:
        json.dump(["a", "{b"], f)
    assert [r["text"] for r in readers.read_json_records(spark, p).orderBy("item").collect()] == ["a", "{b"]
    q = spark.createDataFrame([(0, '{"q1": "{x} what", "q2": {"text": "t"}, "q3": 4}')], "line_key long, value string")
    assert {(r["qid"], r["text"]) for r in readers.parse_queries(q).collect()} == {("q1", "{x} what"), ("q2", "t")}
    c = spark.createDataFrame([(0, '{"d1": {"title": "T", "text": "x"}, "d2": "{x} str"}')], "line_key long, value string")
    assert [(r["doc_id"], r["title"], r["text"]) for r in readers.parse_corpus(c).collect()] == [("d1", "T", "T x")]


def test_lines_that_are_no_object(spark):
    rows = [(1, '{"_id": "a", "text": "t", "title": ""}'), (2, "5"), (3, '["a"]'), (4, "null"), (5, '"x"'), (6, " "), (7, "{")]
    lines = spark.createDataFrame(rows, "line_key long, value string")
    for parse in (readers.parse_labelled, readers.parse_queries, readers.parse_corpus, readers.parse_qrels):
        with pytest.raises(Exception, match="malformed JSON line"):
            parse(lines.filter("line_key in (1, 2)")).collect()
        with pytest.raises(Exception, match="malformed JSON line"):
            parse(lines.filter("line_key in (1, 3)")).collect()
    assert [r["qid"] for r in readers.parse_queries(lines, malformed="skip").collect()] == ["a"]
    assert [r["text"] for r in readers.parse_labelled(lines, malformed="skip").collect()] == ["t"]
    assert [r["line_key"] for r in readers.rejects(lines, objects=True).orderBy("line_key").collect()] == [2, 3, 4, 5, 7]
    assert [r["line_key"] for r in readers.rejects(lines).orderBy("line_key").collect()] == [7]
