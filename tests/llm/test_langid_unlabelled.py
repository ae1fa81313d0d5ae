"""Tables without a language to learn."""

from fieldspan.llm import langid

from test_text_operators import table


def test_without_languages_only_letterless_texts_go(spark):
    rows = [(1, "some words", None), (2, None, None), (3, "12 !!", None), (None, "é", None), (5, "", None)]
    assert {r["doc_id"] for r in langid.keep_known(table(spark, rows)).collect()} == {1, None}
