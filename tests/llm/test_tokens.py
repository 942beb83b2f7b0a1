import zlib

import numpy as np
from tokenizers import Tokenizer

from glossa.llm import op2_tokens, op6_packing
from glossa.llm.stages import stage_path
from glossa.llm.tokens import PieceEncoder, tokenizer_path
from llm_corpus import empty, sorted_rows, texts

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
MORE = ["  a  b ", "x\n\ny  z", "<|endoftext|> a b<|endoftext|>c", "ÀÉ İstanbul ΣΑΣ, naïve don't I'M we'll 123,45. ①²", "q\x1cr",
        "a ", " ", "\n", "it's. a.b, (c) é x́. é?! <|ENDOFTEXT|>", "ends with space ", "tab\tand nbsp x"]


def _whole(path, rows, end):
    tok = Tokenizer.from_file(path)
    return [np.asarray(e.ids + end, "<u4") for e in tok.encode_batch([t or "" for t in rows], add_special_tokens=False)]


def test_pieces_equal_whole_texts():
    rows = [t for _, t in texts()] + MORE
    for path, cut in ((BYTES, "space"), (WORDS, "word")):
        enc = PieceEncoder(path, cut)
        for _ in range(2):                  # cold and warm cache
            got = [np.frombuffer(b, "<u4") for b in enc.encode(rows)]
            for a, b, t in zip(got, _whole(path, rows, []), rows):
                assert np.array_equal(a, b), (cut, t)
        enc.young, enc.old = type(enc.young)(enc), dict(enc.young)
        assert [b for b in enc.encode(rows)] == [x.tobytes() for x in _whole(path, rows, [])]


def test_token_files_round_trip(spark, stored):
    folder = stage_path(spark, "test-tokens")
    manifest = op2_tokens.write_token_files(stored, folder, BYTES)
    got = [tuple(r) for r in op2_tokens.read_token_files(manifest, folder).orderBy("start").collect()]
    want, ids = {}, dict()
    for (key, _), x in zip(texts(), _whole(BYTES, [t for _, t in texts()], [0])):
        want.setdefault(key, []).append((len(x), zlib.crc32(x.tobytes())))
    at = 0
    for key, start, n, crc in got:
        assert start == at
        at += n
        want[key].remove((n, crc))
    assert not any(want.values())
    known = [g[0] for g in got if g[0] is not None]
    assert known == sorted(known) and got[0][0] is None
    # random access to a short document of any file
    for path in [r["path"] for r in manifest.collect()]:
        f = op2_tokens.TokenFile(path, folder)
        for i in (len(f) - 1, 0):
            assert len(f.document(i)) == f.counts[i] and f.document(i)[-1] == 0
        f.close()


def test_a_file_with_another_dictionary_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    folder = str(tmp_path / "f")
    m = op2_tokens.write_token_files(df, folder, BYTES).first()
    name = next(p for p in (tmp_path / "f").iterdir() if p.suffix == ".dict")
    name.write_bytes(b"other")
    try:
        op2_tokens.TokenFile(m["path"], folder)
        raise AssertionError("accepted")
    except ValueError as e:
        assert "another hash" in str(e)


def test_ids_that_do_not_fit_are_refused(spark, tmp_path):
    assert op2_tokens.id_width(BYTES, 0) == 2 and op2_tokens.id_width(BYTES, 1 << 16) == 4
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    for end, width in ((1 << 16, 2), (0, 3)):
        try:
            op2_tokens.write_token_files(df, str(tmp_path / "g"), BYTES, end, width)
            raise AssertionError("accepted")
        except ValueError as e:
            assert "do not fit" in str(e)
    folder = str(tmp_path / "h")
    m = op2_tokens.write_token_files(df, folder, BYTES, 1 << 16)
    f = op2_tokens.TokenFile(m.first()["path"], folder)
    assert f.width == 4 and f.document(0).tolist()[-1] == 1 << 16
    f.close()


def test_files_grow_in_number_with_the_texts(spark, stored, tmp_path, monkeypatch):
    monkeypatch.setattr(op2_tokens, "FILE_BYTES", 1 << 10)
    folder = str(tmp_path / "f")
    m = op2_tokens.write_token_files(stored, folder, BYTES)
    assert m.count() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = [r["n_tokens"] for r in op2_tokens.read_token_files(m, folder).collect()]
    assert sorted(got) == sorted(len(x) for x in _whole(BYTES, [t for _, t in texts()], [0]))


def test_packing(spark, stored):
    got = [tuple(r) for r in op6_packing.pack_documents(stored, WORDS).collect()]
    want = []
    for (key, _), x in zip(texts(), _whole(WORDS, [t for _, t in texts()], [1])):
        want += [(key, k, a, len(x[a:a + 4096]), zlib.crc32(x[a:a + 4096].tobytes())) for k, a in enumerate(range(0, len(x), 4096))]
    assert sorted((g[:5] for g in got), key=repr) == sorted(want, key=repr)
    places = {}
    for g in got:
        places.setdefault(g[5], []).append((g[6], g[3]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-sum(g[3] for g in got) // 4096) + 2


def test_plan_places_each_document_once():
    rng = np.random.default_rng(0)
    for case in ({}, {4096: 5}, {1: 100_000}, {2049: 3, 2047: 3, 1: 3}, {int(k): int(v) for k, v in zip(
            rng.integers(1, 4097, 300), rng.integers(1, 400, 300))}, {700: 10_000, 30: 7}):
        seg, sequences = op6_packing.plan(case)
        fill, seen = {}, {}
        for length, r, n, first, per, offset in seg.tolist():
            assert r == seen.get(length, 0)
            seen[length] = r + n
            for t in range(n):
                fill.setdefault(first + t // per, []).append((offset + t % per * length, length))
        assert seen == case and len(fill) == sequences
        for p in fill.values():
            at = 0
            for o, length in sorted(p):
                assert o == at
                at += length
            assert at <= 4096
        tokens = sum(k * v for k, v in case.items())
        assert sequences <= -(-tokens // 4096) * 1.35 + 2


def test_empty_tables(spark):
    folder = stage_path(spark, "test-tokens")
    assert op2_tokens.read_token_files(op2_tokens.write_token_files(empty(spark), folder, BYTES), folder).count() == 0
    assert sorted_rows(op6_packing.pack_documents(empty(spark), WORDS), ["doc_id"]) == []
