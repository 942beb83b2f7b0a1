"""A small corpus with every awkward case, and the columns the operators
might stumble over."""

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "size long, `row` string, _text string, `a.b` string, b long")


def base_documents():
    return [tuple(r.values()) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


def edge_rows():
    passage = " ".join(f"pass{i}" for i in range(60))
    line = "All of this is repeated on each page."
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    texts = [
        (900001, None), (900002, ""), (900003, " \t\n\x0b "), (900004, "one two three"), (900005, "One Two THREE"),
        (900006, "x"), (900007, f"intro a b {passage} end c d"), (900008, f"other {passage}"), (900009, passage),
        (900010, passage), (900010, passage), (900011, "a " * 40), (900012, "a" * 200), (900013, "b" + "a" * 120),
        (900014, long), (900015, long + " tail"), (900016, f"{line}\nsome text here\n{line}"),
        (900017, f"{line}\nmore words\n\n {line} "), (900018, f"{line}\r\nand another"), (900019, "é" * 60 + " ü"),
        (900020, "　wide　space  nbsp"), (900021, "<|endoftext|> is text, and <|startoftext|> too"),
        (900021, "the same id with another text"), (None, passage), (None, None), (-5, "a negative id " + passage),
        (900022, "It's 3,141 don't!! WHAT?? i'd 12ab ①² x́  double  space "), (900023, "é café \U0001f600 \U0001f600"),
    ]
    out = []
    for i, (key, text) in enumerate(texts):
        source = None if i % 9 == 0 else "site" if i % 2 else "src0"
        lang = None if i % 11 == 0 else "en"
        out.append((key, text, lang, source, None if text is None else len(text)))
    return out


def corpus(spark, partitions=3):
    rows = [(*r, i, f"row{i}", "clash", None, i) for i, r in enumerate(base_documents() + edge_rows())]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(r[0], r[1]) for r in base_documents() + edge_rows()]


def sorted_rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
