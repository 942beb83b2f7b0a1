"""Operator 10: toxicity by gradient-boosted trees over dense features.

1. *Sample.*  Labels of training rows (``crc32(id) mod 5 <> 0``) only: at
   most ``TOXIC_ROWS`` toxic and ``CLEAN_ROWS`` other rows, the smallest by
   ``xxhash64(id)``.  The sample's ids are broadcast (their number is the
   parameter), so no text is shuffled.
2. *Lexicon.*  Words and word beginnings of four to seven letters of the
   toxic sample, kept where a likelihood ratio test with a correction for
   all candidates tells them from the clean sample; at most
   ``LEXICON_TERMS``.
3. *Features* of a whole text: lexicon densities (hits, distinct terms,
   weight, most hits in a stretch of text), hits near a second person, hits
   seen only after undoing letter substitutions, capitals, exclamation and
   question marks, digits, letters replaced inside words, length.  Neither
   id, language, source nor label is an input.
4. *Model.*  Spark ML gradient-boosted trees on four fifths of the sample,
   isotonic regression of their probability on the rest, weighted back to
   the share of toxic rows among all training labels.

Scoring is one pass over the texts; nothing is shuffled.

Defined cases: null or empty text is scored like a text without any hit;
null labels are ignored, of several labels of one id the highest counts; a
null id counts as held out = false; with no toxic or no clean training row
every score is the share of toxic training rows (0 without labels); other
columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import kernels
from glossa.llm.stages import staged

FOLDS = 5
TOXIC_ROWS = 20_000
CLEAN_ROWS = 40_000
CANDIDATE_TERMS = 20_000
LEXICON_TERMS = 2_000
MIN_DOCS = 4
NEAR = 40              # characters between a hit and a second person
STRETCH = 300          # characters of a stretch
TREES, DEPTH, STEP, SEED = 20, 3, 0.2, 7

#: Second-person words of the languages covered.
SECOND_PERSON = ("you", "your", "yours", "yourself", "ya", "u", "ur", "thou", "du", "dich", "dir", "dein", "deine",
                 "deinen", "deiner", "ihr", "euch", "euer", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre",
                 "vos", "tú", "ti", "tus", "usted", "ustedes", "vosotros", "vuestro")
_SECOND = re.compile(r"\b(?:" + "|".join(SECOND_PERSON) + r")\b")
#: Letters that digits and signs stand for.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
_UNDO = str.maketrans(SUBSTITUTES)
_DISGUISED = re.compile(r"[^\W\d_][0134579@$!|*]+[^\W\d_]|\b[@$0-9][^\W\d_]")
_WORD = re.compile(r"[^\W\d_]+")

FEATURES = ("hits", "hit_rate", "distinct_terms", "weight_rate", "top_weight", "stretch_hits", "near_second_person",
            "near_rate", "disguised_hits", "capitals", "exclamations", "questions", "digits", "replaced_letters", "length")

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SIGN = _DIGIT.copy()
_SIGN[[ord(c) for c in "@$*!|"]] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _terms(text: str) -> set[str]:
    """Words and beginnings (marked ``=`` and ``^``) of a text."""
    out = set()
    for w in set(_WORD.findall(text.lower())):
        if len(w) >= 3:
            out.add("=" + w)
        for k in range(4, min(8, len(w))):
            out.add("^" + w[:k])
    return out


def sample_labels(docs: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    """At most ``TOXIC_ROWS + CLEAN_ROWS`` training ids with label and the
    weight that undoes the sampling."""
    known = (labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label")))
    known = staged(known.withColumn("h", F.xxhash64("doc_id")), "labels")
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    parts = []
    for value, most in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        n = counts.get(value, 0)
        weight = n / min(n, most) if n else 1.0
        parts.append(known.filter(F.col("label") == value).orderBy("h", "doc_id").limit(most)
                     .withColumn("weight", F.lit(weight)))
    return staged(parts[0].unionByName(parts[1]).select("doc_id", "label", "weight", "h"), "sample"), counts


def learn_lexicon(texts: DataFrame) -> dict[str, float]:
    """Terms with their weight (log odds) from sample rows ``text, label``;
    only term counts reach the driver, at most ``CANDIDATE_TERMS``."""
    def counts(keep):
        def count(batches):
            seen: dict[str, int] = {}
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    for w in _terms(t or ""):
                        if keep is None or w in keep:
                            seen[w] = seen.get(w, 0) + 1
                if len(seen) > 2_000_000:
                    yield flush(seen)
                    seen = {}
            yield flush(seen)
        return count

    def flush(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                          names=["term", "n"])

    def gathered(label, keep):
        return (texts.filter(F.col("label") == label).select("text").mapInArrow(counts(keep), "term string, n long")
                .groupBy("term").agg(F.sum("n").alias("n")))

    toxic = {r[0]: r[1] for r in gathered(1, None).filter(F.col("n") >= MIN_DOCS)
             .orderBy(F.desc("n"), "term").limit(CANDIDATE_TERMS).collect()}
    clean = {r[0]: r[1] for r in gathered(0, frozenset(toxic)).collect()}
    rows = {r[0]: r[1] for r in texts.groupBy("label").count().collect()}
    t_all, c_all = rows.get(1, 0), rows.get(0, 0)
    bar = 2 * math.log(max(len(toxic), 1)) + 4
    scored = []
    for term, t in toxic.items():
        c = clean.get(term, 0)
        share = (t + c) / (t_all + c_all)
        ratio = 2 * (t * math.log(t / (t_all * share)) + (c * math.log(c / (c_all * share)) if c else 0.0))
        odds = math.log((t + 0.5) / (t_all + 1)) - math.log((c + 0.5) / (c_all + 1))
        if ratio >= bar and odds >= math.log(8):
            scored.append((ratio, term, odds))
    return {term: odds for _, term, odds in sorted(scored, reverse=True)[:LEXICON_TERMS]}


class Scanner:
    """Dense features of texts, given a lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        import ahocorasick
        self.found = ahocorasick.Automaton()
        spelled: dict[str, list] = {}
        for term, weight in lexicon.items():
            spelled.setdefault(term[1:], []).append((term[0], weight))
        for word, kinds in spelled.items():
            self.found.add_word(word, (word, dict(kinds)))
        self.any = bool(spelled)
        if self.any:
            self.found.make_automaton()

    def _hits(self, text: str):
        """(place, word, weight), one per place: the weightiest term."""
        best: dict[int, tuple[float, str]] = {}
        n = len(text)
        for end, (word, kinds) in self.found.iter(text):
            at = end + 1 - len(word)
            if at and text[at - 1].isalpha():
                continue
            closed = end + 1 == n or not text[end + 1].isalpha()
            weight = max(kinds.get("^", 0.0), kinds.get("=", 0.0) if closed else 0.0)
            if weight and best.get(at, (0.0, ""))[0] < weight:
                best[at] = (weight, word)
        return [(at, word, weight) for at, (weight, word) in sorted(best.items())]

    def lexical(self, text: str) -> tuple[float, ...]:
        """hits, distinct, weight, top, stretch, near, disguised."""
        if not self.any or not text:
            return (0.0,) * 7
        low = text.lower()
        hits = self._hits(low)
        disguised = 0
        if _DISGUISED.search(low):
            undone = low.translate(_UNDO).replace("*", "")
            disguised = max(0, len(self._hits(undone)) - len(hits))
            if disguised and not hits:
                low, hits = undone, self._hits(undone)
        if not hits:
            return (0.0,) * 6 + (float(disguised),)
        places = np.asarray([h[0] for h in hits])
        stretch = (np.searchsorted(places, places + STRETCH) - np.arange(len(places))).max()
        near = sum(1 for at, word, _ in hits if _SECOND.search(low, max(0, at - NEAR), at + len(word) + NEAR))
        return (float(len(hits)), float(len({h[1] for h in hits})), float(sum(h[2] for h in hits)),
                float(max(h[2] for h in hits)), float(stretch), float(near), float(disguised))

    def features(self, column) -> np.ndarray:
        """One row of ``FEATURES`` per text of an Arrow string column."""
        out = np.zeros((len(column), len(FEATURES)))
        for pack in kernels.packs(column):
            w = kernels.words(pack)
            n_words = np.maximum(w.counts(), 1)
            data, offs = pack.data, pack.offsets

            def per_text(mask):
                total = np.append(0, np.cumsum(mask))
                return total[offs[1:]] - total[offs[:-1]]

            letters = np.maximum(per_text(_LETTER[data]), 1)
            inside = np.zeros(len(data), dtype=bool)
            if len(data) > 2:
                inside[1:-1] = _SIGN[data[1:-1]] & _LETTER[data[:-2]] & _LETTER[data[2:]]
            raw = data.tobytes()
            lex = np.asarray([self.lexical(raw[a:b].decode("utf-8")) for a, b in zip(offs[:-1], offs[1:])]).reshape(-1, 7)
            rows = out[pack.first:pack.first + pack.n]
            rows[:, 0], rows[:, 1], rows[:, 2] = lex[:, 0], lex[:, 0] / n_words, lex[:, 1]
            rows[:, 3], rows[:, 4], rows[:, 5] = lex[:, 2] / n_words, lex[:, 3], lex[:, 4]
            rows[:, 6], rows[:, 7], rows[:, 8] = lex[:, 5], lex[:, 5] / n_words, lex[:, 6]
            rows[:, 9] = per_text(_CAPITAL[data]) / letters
            rows[:, 10] = per_text(data == ord("!")) / n_words
            rows[:, 11] = per_text(data == ord("?")) / n_words
            rows[:, 12] = per_text(_DIGIT[data]) / letters
            rows[:, 13] = per_text(inside) / n_words
            rows[:, 14] = np.log1p(w.counts())
        return out


def with_features(rows: DataFrame, lexicon: dict[str, float], keep: list[str]) -> DataFrame:
    """Columns ``keep`` and ``x`` (the features of ``text``)."""
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def scan(batches):
        scanner = Scanner(lexicon)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x = scanner.features(part.column(0))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))],
                    names=[*keep, "x"])

    return rows.select("text", *keep).mapInArrow(scan, fields + ", x array<double>")


def _vectors(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    return df.withColumn("features", array_to_vector("x")).drop("x")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic"):
    """(lexicon, trees, calibration), or the constant score where one class
    is missing.  ``docs``: ``doc_id, text``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    picked, counts = sample_labels(docs, labels, label_col)
    if not counts.get(1) or not counts.get(0):
        return float(bool(counts.get(1)))
    texts = docs.filter("doc_id is not null").join(F.broadcast(picked), "doc_id")   # at most the sample's bound
    lexicon = learn_lexicon(texts.select("text", "label"))
    found = _vectors(staged(with_features(texts, lexicon, ["label", "weight", "h"]), "train")) \
        .withColumn("label", F.col("label").cast("double"))
    fit, rest = found.filter("pmod(h, 5) <> 0"), found.filter("pmod(h, 5) = 0")
    n = {r[0]: r[1] for r in rest.groupBy("label").count().collect()}
    if not n.get(1.0) or not n.get(0.0):
        fit = rest = found
    if fit.select("label").distinct().count() < 2:
        return counts[1] / (counts[0] + counts[1])
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=SEED, weightCol="weight",
                          featuresCol="features", labelCol="label").fit(fit.coalesce(4))
    scored = trees.transform(rest).select("label", "weight", vector_to_array("probability")[1].alias("p"))
    return lexicon, trees, IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight").fit(scored)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    from pyspark.ml.functions import vector_to_array
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = train(d, labels.select("doc_id", label_col), label_col)
    if isinstance(model, float):
        scored = d.select("doc_id", F.lit(model).alias("score"))
    else:
        lexicon, trees, calibration = model
        raw = trees.transform(_vectors(with_features(d, lexicon, ["doc_id"])))
        scored = calibration.setPredictionCol("score").transform(
            raw.select("doc_id", vector_to_array("probability")[1].alias("p"))).select("doc_id", "score")
    score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"),
                         (score >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
