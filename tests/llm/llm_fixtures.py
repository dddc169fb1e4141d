"""Small tables with every awkward row."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def docs(spark, rows):
    full = [(i, t, *(rest or ("en", "src0", None if t is None else len(t)))) for i, t, *rest in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [
    (1, "The quick brown fox jumps over the lazy dog's back, again!"),
    (2, None),
    (3, ""),
    (None, "A document that has no id but has a line of some length."),
    (4, "\n\n \t\n"),
    (5, "É ñandú Straße ÇA VA <|endoftext|> x\u0085y z w é …. I'll don't 123 4,5 \U0001f600"),
    (6, "word " * 3000),
    (6, "word " * 3000),
    (7, "a very common line of text here\nunique seven"),
    (8, "A very common LINE of text here  \nunique eight\na very common line of text here"),
    (9, "a very common line of text here"),
    (10, "two documents only have this line\na"),
    (11, "two documents only have this line\nb"),
]
