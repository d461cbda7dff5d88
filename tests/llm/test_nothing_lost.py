"""Texts, columns and names that an operator has no business with stay as they are."""

import pytest
from pyspark.sql import functions as F

from crowdtide.llm import html_crf, line_dedup, ngram_join, pii

ALL = "_key _host _line_keys _lines _kept _found _attempts _made n_lines n_dropped n_replaced row_key region pivot label"


@pytest.fixture(scope="module")
def crowded(spark):
    """A table whose extra columns have the names operators use inside."""
    names = ALL.split()
    texts = ["Menu\nThe first text of all about Mr John Smith", "Menu\nanother one of nine words or so it seems", "Menu\nc", "Menu\nd", "Menu\ne"]
    rows = [(k, t, "s", *[f"{n}{k}" for n in names]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))


@pytest.mark.parametrize("operator", [ngram_join.keep_one, line_dedup.drop_boilerplate, pii.replace])
def test_columns_of_any_name_stay(crowded, operator):
    out = operator(crowded)
    assert out.columns == crowded.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == 5 and all(got[k][n] == f"{n}{k}" for k in got for n in ALL.split())


def test_texts_that_share_an_id_are_different_documents(docs_of):
    a, b, c = "one two three four five six", "nine words that have nothing to do with the others", "some third text of more than five words"
    near = a + " seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty more"
    kept = ngram_join.keep_one(docs_of([(5, a), (5, b), (6, c)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(5, a), (5, b), (6, c)])
    kept = ngram_join.keep_one(docs_of([(5, near), (5, b), (7, near + " end"), (8, near), (5, near), (None, b), (None, c), (None, c)])).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept))) == sorted(map(str, [(5, near), (5, b), (None, c)]))


def test_names_within_longer_names_stay(docs_of):
    text = "Mr John Smith met John Smithson, John Smith-Jones, Ann-John Smith and Frau Anna Meier; Anna Meierhofer and John Smith left, so did John Smith."
    out = pii.replace(docs_of([(1, text)])).first()
    for other in ("John Smithson", "John Smith-Jones", "Ann-John Smith", "Anna Meierhofer"):
        assert other in out["text"]
    rest = out["text"]
    for other in ("John Smithson", "John Smith-Jones", "Ann-John Smith", "Anna Meierhofer"):
        rest = rest.replace(other, "")
    assert "John Smith" not in rest and "Anna Meier" not in rest


@pytest.mark.parametrize("tag", ["canvas", "object", "video", "noscript", "select", "svg", "audio"])
def test_an_unclosed_silent_tag_silences_nothing(tag):
    page = f"<article><h1>Title</h1><{tag} id=c><p>First paragraph.</p><p>Second paragraph.</p></article>"
    assert [b.text for b in html_crf.blocks_of(page)] == ["Title", "First paragraph.", "Second paragraph."]
    closed = f"<article><h1>Title</h1><{tag} id=c>hidden</{tag}><p>First paragraph.</p></article>"
    assert [b.text for b in html_crf.blocks_of(closed)] == ["Title", "First paragraph."]
    assert [b.text for b in html_crf.blocks_of("<p>a</p><script>var x = 1; <p>b</p>")] == ["a"]


def test_long_class_lists_are_read_whole():
    page = "<div class='" + "utility " * 60 + "sidebar'><p>Some text here.</p></div>"
    assert ".sidebar" in html_crf.blocks_of(page)[0].path
