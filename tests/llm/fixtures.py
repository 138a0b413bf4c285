"""Small documents with the awkward cases that operators must take."""

import random

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
SYLLABLES = "ka lo mi ru sen tor vel pax dun gri zo fe ny éb ül".split()


def sentence(draw, n):
    return " ".join("".join(draw.choice(SYLLABLES) for _ in range(draw.randint(1, 3))) for _ in range(n))


def corpus(seed=3, n=120):
    """(doc_id, text) rows: copies, near copies, shared passages, repeats inside a text, very
    long and very short texts, empty ones and null."""
    draw = random.Random(seed)
    passages = [sentence(draw, k) for k in (19, 20, 21, 34, 60)]
    texts = []
    for i in range(n):
        kind = draw.random()
        text = sentence(draw, draw.randint(1, 90))
        if kind < 0.2 and texts:
            text = draw.choice([t for t in texts if t is not None])
        elif kind < 0.4 and texts:
            words = (draw.choice([t for t in texts if t is not None]) or "x").split()
            for _ in range(draw.randint(1, 3)):
                words[draw.randrange(len(words))] = sentence(draw, 1)
            text = " ".join(words)
        elif kind < 0.7:
            p = draw.choice(passages)
            text = f"{sentence(draw, draw.randint(0, 9))} {p}{draw.choice([' ', chr(10), ''])}{sentence(draw, draw.randint(0, 9))}"
        elif kind < 0.75:
            text = f"{text} {text}\n{text}"
        texts.append(text)
    texts += ["", None, " \n\t ", "one", "x" * 5000, "ab" * 300, "é" * 200, sentence(draw, 4000), "İstanbul ß \U0001f600 z"]
    ids = draw.sample(range(-50, 1000), len(texts))
    return list(zip(ids, texts, strict=True))


def documents(spark, rows):
    full = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def awkward(spark):
    """Null in every column, repeated rows, and extra columns named like results."""
    rows = [(None, None, None, None, None), (1, "a b c", None, None, 5), (1, "a b c", None, None, 5), (2, None, "en", "s", None)]
    rows += [(None, "a b c", "en", "s", 5), (3, "", "de", "s", 0)]
    df = spark.createDataFrame(rows, DOCUMENTS)
    from pyspark.sql import functions as F

    clash = "size target taken rate copies score kept n_words block kind body text_ _0 component_id lang_pred n key node".split()
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(clash)))
