"""Small documents with nulls, empty and long texts, ties and repeated rows."""

SCHEMA = "doc_id long, text string"

ODD_TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "Ünïcode ΣΑΣ é  x y"), (7, "a" * 5000),
    (8, "word " * 3000), (9, "x\n\n\ny\r\nz\x0b\x0cw"), (9, "x\n\n\ny\r\nz\x0b\x0cw"), (None, "no id at all here"), (11, "tie"),
    (12, "tie"), (13, "<|endoftext|> it's <|startoftext|>x don't"), (14, "日本語のテキスト 混ざる mixed 123 4567 !!?? ---"),
]


def odd_docs(spark):
    return spark.createDataFrame(ODD_TEXTS, SCHEMA)


def clashing(docs, **cols):
    """``docs`` with columns of these names added."""
    from pyspark.sql import functions as F
    return docs.withColumns({k: F.lit(v) for k, v in cols.items()})


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
