"""Text column expressions (P1-P7): record shapes, model prefixes, tokens.

All of them are Catalyst expressions (no Python per row).  The default
tokenizer splits on whitespace; a subword tokenizer can be plugged in
through ``glossa.operators.encoder`` (U2).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace class of the default tokenizer, and of the
# strip() of texts (Unicode white space and the separator controls).
WS_SPLIT = r"\s+"
WS_STRIP = r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]"
WS_TRIM = rf"^{WS_STRIP}+|{WS_STRIP}+$"

# Model-name rules for query and passage prefixes, first match
# wins.  ("contains", needles) tests the lower-cased name; ("equals", name)
# tests the name as given.
QUERY_PREFIX_RULES = [
    (("contains", ("e5", "snowflake-arctic-embed")), "query: "),
    (("contains", ("qwen", "gte-qwen")),
     "Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery: "),
    (("contains", ("jina",)), "Represent the query for retrieving evidence documents: "),
    (("contains", ("embeddinggemma",)), "task: search result | query: "),
    (("equals", ("nvidia/llama-nemotron-embed-1b-v2",)), "query: "),
    (("contains", ("mxbai",)), "Represent this sentence for searching relevant passages: "),
]
PASSAGE_PREFIX_RULES = [
    (("contains", ("e5",)), "passage: "),
    (("contains", ("jina",)), "Represent the document for retrieval: "),
    (("contains", ("embeddinggemma",)), "title: none | text: "),
    (("equals", ("nvidia/llama-nemotron-embed-1b-v2",)), "passage: "),
]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(col) -> Column:
    """``str.strip()``: Unicode white space at both ends."""
    return F.regexp_replace(_c(col), WS_TRIM, "")


def standardise_passage(title, text) -> Column:
    """``title + "\\n" + text`` (a null part counts as empty)."""
    return F.concat_ws("\n", F.coalesce(_c(title), F.lit("")), F.coalesce(_c(text), F.lit("")))


def standardise_pair(query, positive) -> Column:
    """``query + "\\n" + positive``; the negative is dropped."""
    return F.concat_ws("\n", F.coalesce(_c(query), F.lit("")),
                       F.coalesce(_c(positive), F.lit("")))


def doc_text(title, text) -> Column:
    """P5: ``strip(title + ' ' + text)`` when the title is non-empty, else
    ``strip(text)``."""
    t = F.coalesce(_c(title), F.lit(""))
    x = F.coalesce(_c(text), F.lit(""))
    return F.when(t != "", strip(F.concat(t, F.lit(" "), x))).otherwise(strip(x))


def _prefix(model, rules) -> Column:
    m = _c(model)
    low = F.lower(m)
    expr = None
    for (kind, needles), prefix in rules:
        if kind == "contains":
            cond = None
            for nd in needles:
                c = low.contains(nd)
                cond = c if cond is None else (cond | c)
        else:
            cond = m == needles[0]
        expr = F.when(cond, F.lit(prefix)) if expr is None else expr.when(cond, F.lit(prefix))
    return expr.otherwise(F.lit(""))


def query_prefix(model) -> Column:
    """The query prefix of a model name ('' when none applies)."""
    return _prefix(model, QUERY_PREFIX_RULES)


def passage_prefix(model) -> Column:
    """The passage prefix of a model name ('' when none applies)."""
    return _prefix(model, PASSAGE_PREFIX_RULES)


def with_query_prefix(text, model) -> Column:
    return F.concat(query_prefix(model), F.coalesce(_c(text), F.lit("")))


def with_passage_prefix(title, text, model, drop_title_when_prefixed: bool = True) -> Column:
    """P4 applied: with a prefix the text becomes ``prefix + text`` and the
    title is dropped (flag); without one, ``doc_text(title, text)``."""
    pre = passage_prefix(model)
    body = F.coalesce(_c(text), F.lit("")) if drop_title_when_prefixed else doc_text(title, text)
    return F.when(pre != "", F.concat(pre, body)).otherwise(doc_text(title, text))


def tokens(text) -> Column:
    """U2 default: whitespace tokens.  The text is stripped first, so the
    split yields no empty token (no per-token lambda; stays in codegen)."""
    t = strip(F.coalesce(_c(text), F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WS_SPLIT))


def token_count(text) -> Column:
    """Number of tokens."""
    return F.size(tokens(text))


def truncate_tokens(text, max_tokens: int) -> Column:
    """The first ``max_tokens`` tokens, joined by one space."""
    return F.array_join(F.slice(tokens(text), 1, max_tokens), " ")


def split_sources(source) -> Column:
    """Comma-separated sources, each stripped."""
    return F.transform(F.split(F.coalesce(_c(source), F.lit("")), ","), lambda s: strip(s))
