"""No unrelated text is lost where rows share an id."""

from tidemark.llm import ngram_join

A = "one two three four five six seven eight nine ten eleven"
B = "red green blue white black brown grey pink violet orange teal"


def test_one_id_with_two_texts(spark):
    rows = [(1, A, "x"), (1, B, "x"), (1, B, "w"), (2, A + " ", "x"), (3, None, "x"), (3, None, "x"), (None, A, "n"), (None, A, "n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted((tuple(r) for r in ngram_join.keep_first(docs).collect()), key=repr)
    assert got == sorted([(1, A, "x"), (1, B, "w"), (3, None, "x"), (None, A, "n"), (None, A, "n")], key=repr)
