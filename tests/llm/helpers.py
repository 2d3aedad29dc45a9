"""Small documents with every awkward case."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        T.StructField("d", T.StringType()),
        T.StructField("t", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("slice", T.StringType()),
    ]
)

LONG = " ".join(f"word{i % 977} and, text{i % 31}." for i in range(20_000))

TEXTS = [
    "The quick brown fox jumps over the lazy dog near the river bank today.",
    "The quick brown fox jumps over the lazy dog near the river bank today.",
    "the QUICK brown fox jumps over the lazy dog near the river bank today.",
    "",
    None,
    " ",
    "one",
    "two words",
    "  two   spaces\n\n and\ttabs   odd \x1c blanks\r\n",
    "special <|endoftext|> and <|startoftext|> strings",
    "Größe, naïve café — ÀÉÎ İstanbul ΣΑΣ é 日本語 🙂🙂",
    "write to jane.doe@mail.example.com or +1 (203) 555-8282, card 4111 1111 1111 1111 from 10.0.0.255",
    "1.2.3.4.5.6.7.8 999.1.1.1 a@b a@b.c@d.e +12 4111-1111-1111-1112",
    LONG,
    "x" * 30_000,
    "a b c d e f g h i j k l m n o p q r s t u v w x y z",
]


def rows():
    out = [(i, t, "en", "s", None if t is None else len(t), "x", i, None, 1, "y") for i, t in enumerate(TEXTS)]
    return [*out, (0, TEXTS[0], None, None, None, None, None, None, None, None), (None, "a row without an id", "en", "s", 19, "x", 1, "k", 1, "y")]


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
