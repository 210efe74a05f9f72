import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType().add("doc_id", "long").add("text", "string").add("lang", "string").add("source", "string").add("n_chars", "long")
#: Texts that every operator must take: none, white space of all kinds, marks, controls, other scripts, long.
ODD = [None, "", " ", "\n", "a", " \t\x0b\x0c\r\n x \n", "one two three", "x\n\nx\nx", "▁a ▁▁b", "é" * 40, "日本語 テスト", "\U0001f600 \x00 \x01", "<s> </s> <|endoftext|>", "it's we'll\u2003wide\xa0space", "A" * 5000, "word " * 3000, "## $$ %% && ||"]


def prose(r, n, letters="abcdefghij"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Odd texts, prose, exact and near copies, repeated rows and null ids; with columns of clashing names."""
    r = random.Random(1)
    texts = list(ODD)
    for _ in range(25):
        base = prose(r, r.randint(5, 200))
        texts.append(base)
        words = base.split()
        for _ in range(r.randint(0, 4)):
            w = list(words)
            for _ in range(r.randint(1, max(1, len(w) // 30))):
                w[r.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
        if r.random() < 0.4:
            texts += [base.upper(), base]
    rows = [(i, t, r.choice(["en", "de", None]), "s", len(t) if t else None) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, "null id text here is one", "en", None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(corpus, DOCS).selectExpr("*", "'x' AS key", "1 AS n", "'y' AS _text", "2 AS score", "'z' AS cls", "3 AS id", "4 AS th").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
