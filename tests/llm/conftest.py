from __future__ import annotations

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text, lang, source) tuples, in several partitions, with extra columns
    that operators use as names of their own."""
    def build(rows, parts=3):
        full = [(i, t, la, s, len(t or ""), 7, "x") for i, t, la, s in rows]
        df = spark.createDataFrame(full, DOC + ", size bigint, score string")
        return df.repartition(parts)
    return build


#: Nulls in every column, empty and blank texts, a very long text, ties and repeated rows.
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None),
    (4, "one two three", "en", None), (5, "one two three", None, "b"),
    (6, "the cat sat on the mat and looked at the dog " * 900, "en", "b"),
    (7, "Ünï cödé ＡＢＣ 漢字 <|endoftext|> it's 42!!", "de", "c"),
    (8, "a b c d e f g h i j k l m n o p q r s t u v w", "en", "a"),
    (8, "a b c d e f g h i j k l m n o p q r s t u v w", "en", "a"),
    (None, "no id at all but some words in it", "en", "a"),
    (None, "no id at all but some words in it", "en", "a"),
    (9, "a b c d e f g h i j k l m n o p q r s t u v x", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)


@pytest.fixture(scope="session")
def none(make, spark):
    return make(ODD[:1]).filter("false")
