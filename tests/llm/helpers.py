"""Edge rows shared by the tests of this folder."""

import random

EDGE_TEXTS = [None, "", " ", "\n\n", "word", "a b c d", "Same text here for two rows of this table.", "Same text here for two rows of this table.",
              "İ K ſ é Σ end", "x" * 30_000, "long " * 6_000, "\t tab\x0b and\x0c feed \r\n line", "1 2 3 4 5 6 7 8 9 10 11 12"]


def edge_docs(spark, texts=EDGE_TEXTS):
    """Documents with null and repeated ids, and columns whose names operators might use themselves."""
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)]
    rows += [(3, texts[3], "x", 1, "y"), (3, "other text for an id that is there", "x", 1, "y"), (None, "no id at all", "x", 1, "y"), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ref string, n int, token string")


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, ref string, n int, token string")


def prose(seed, words=80, vocabulary=400):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and"]) if r.random() < 0.2 else f"w{r.randrange(vocabulary)}" for _ in range(words))


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(f"e{r.randrange(10**6)}" if r.random() < share else w for w in text.split(" "))
