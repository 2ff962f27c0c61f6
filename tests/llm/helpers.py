"""Documents that every operator must survive, and writing small tables where queries look for them."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard int, spans string"
LONG = "word " * 30_000 + "end"

EDGE = [
    (None, "a text without an id, long enough to be looked at by all of them", "en", None, None, "x", 1, "y"),
    (1, None, "en", "s", 1, "x", 1, "y"),
    (2, "", None, "s", 1, "x", 1, "y"),
    (3, " \n\t ", "en", None, 1, None, None, None),
    (4, LONG, "en", "s", 1, "x", 1, "y"),
    (5, "the same text in two rows of one id", "en", "s", 1, "x", 1, "y"),
    (5, "the same text in two rows of one id", "en", "s", 1, "x", 1, "y"),
    (6, "the same text in two rows of one id", "de", "s", 1, "x", 1, "y"),
    (7, "12345 !!! ???", "en", "s", 1, "x", 1, "y"),
    (8, "日本語の文章です。 Ünïcode \U0001f600 text", None, "s", 1, "x", 1, "y"),
]


def edge_documents(spark):
    return spark.createDataFrame(EDGE, DOCS)


def write(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
