"""Documents that have every awkward case once."""

import random

import pytest
from pyspark.sql import functions as F

CLASHES = ["batch", "part", "payload", "id", "n", "rep", "key", "words", "n_words", "host", "label_"]


def corpus():
    r = random.Random(7)
    vocab = ["the", "of", "And", "naïve", "x,", "…", "re-do", "ZEBRA", "ß", "日本語"] + [f"w{i}" for i in range(400)]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", " ", "  ", "\n", "\t", " \r\n"]) for _ in range(n))
    passage = text(60)
    docs = [(i, text(r.randint(0, 120))) for i in range(60)]
    docs += [(100 + i, text(15) + passage + text(r.randint(0, 20))) for i in range(12)]  # a shared passage
    base = text(150)
    docs += [(200, base), (201, base), (205, base.lower()), (203, base + " more"), (204, base.replace("the", "a", 2))]  # copies and near copies
    docs += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "one"), (305, "Two words"), (306, "two WORDS"), (307, "a" * 5000), (308, "x " * 3000), (309, text(9000))]
    docs += [(310, "\u00a0no break\u3000space \u2003 here\x1c!"), (311, "<|endoftext|> ▁ mark"), (None, text(40)), (312, "it's we're I'll\n\n\n  end  ")]
    docs += [(400, "again and again " * 30), (400, "again and again " * 30)]  # a repeated row
    return docs


DOCS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if k % 11 == 0 else f"src{k % 3}") for k, (i, t) in enumerate(DOCS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES)))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < -1")
