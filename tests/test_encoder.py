import re

import numpy as np

from glossa.operators import encoder

ODD = ["", " \t", "eins zwei\n drei", " größe   naïve\x1c x\x85", "🙂 a🙂b \x0b\x0c", "a", "\n\n z"]


def test_spans_and_words_of_odd_texts(spark):
    texts = [*ODD, None, "wort größe 🙂 " * 60_000]           # a long text: one walk, not one for each token
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: r for r in encoder.token_spans(df, words_col="words").collect()}
    for i, t in enumerate(texts):
        want = [(m.span(), m.group()) for m in re.finditer(r"\S+", t or "", re.ASCII)]
        assert [tuple(s) for s in got[i]["spans"]] == [s for s, _ in want]
        assert got[i]["words"] == [w for _, w in want]


def test_words_of_any_spans(spark):
    """Spans that overlap, leave gaps or are empty, as subword vocabularies give."""
    class Odd:
        def __call__(self):
            return lambda texts: [np.array([(0, 2), (1, 3), (4, 4), (3, 5)]) for _ in texts]

    df = spark.createDataFrame([(1, "größe"), (2, "abcde")], "id int, text string")
    got = {r["id"]: r["words"] for r in encoder.token_spans(df, Odd(), words_col="words").collect()}
    assert got == {1: ["gr", "rö", "", "ße"], 2: ["ab", "bc", "", "de"]}


def test_hashed_words_are_hashed_once_a_piece(monkeypatch):
    import hashlib
    plain, calls = hashlib.md5, []
    monkeypatch.setattr(hashlib, "md5", lambda w: calls.append(w) or plain(w))
    texts = [*ODD, "der die der das " * 500]
    got = encoder.HashedBagOfWords(16)()(texts)
    words = [[w for w in re.split(r"\s+", t.strip(), flags=re.ASCII) if w] for t in texts]
    assert len(calls) == len({w for ws in words for w in ws})
    for row, ws in zip(got, words):
        want = np.zeros(16)
        for w in ws:
            want[int(plain(w.encode()).hexdigest()[:8], 16) % 16] += 1
        assert np.array_equal(row, want / max(np.sqrt((want * want).sum()), 1e-12))
