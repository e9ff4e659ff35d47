"""Column functions against cases worked out by hand."""

import html

import pytest
from pyspark.sql import functions as F

from pagetrove.functions import text, urls
from pagetrove.functions.fuzzy import contains_ratio, partial_levenshtein
from pagetrove.functions.highlight import highlight, word_variants
from pagetrove.functions.register import register_functions
from pagetrove.operators.links import is_denied


def values(spark, inputs, column, schema="x string"):
    """``column`` over rows of inputs, in input order."""
    rows = [(i,) + (tuple(x) if isinstance(x, tuple) else (x,)) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, {schema}").select("i", column.alias("v"))
    return [r.v for r in sorted(df.collect())]


@pytest.mark.parametrize("url,expected", [
    ("https://h.com/a/b/c", "h.com › a › b"),
    ("https://h.com/a/page.html", "h.com › a"),
    ("https://h.com/" + "x" * 60, "h.com › ..."),
    ("https://H.com", "h.com"),
    ("https://h.com//a/b", "h.com › a"),
    ("https://h.com/für/x", "h.com › f%C3%BCr › x"),
])
def test_breadcrumb(spark, url, expected):
    assert values(spark, [url], urls.breadcrumb(F.col("x"))) == [expected]


def test_hosts_and_sites(spark):
    cases = ["https://WWW.A.example.com:80/x", "http://user:pw@b.org?q", "not a url", "https://a.co.uk/"]
    assert values(spark, cases, urls.hostname(F.col("x"))) == ["www.a.example.com", "b.org", None, "a.co.uk"]
    pairs = [("www.a.example.com", "b.example.com"), ("a.co.uk", "b.co.uk"), ("a.com", "a.org")]
    same = urls.same_site(F.col("a"), F.col("b"))
    assert values(spark, pairs, same, "a string, b string") == [True, True, False]


def test_query_or_fragment(spark):
    cases = ["https://h.com/a?p=1", "https://h.com/a#t", "https://h.com/a?", "https://h.com/a#", "https://h.com/a", "https://h.com/a#x?y"]
    assert values(spark, cases, urls.has_query_or_fragment(F.col("x"))) == [True, True, False, False, False, True]


def test_resolve_link(spark):
    base = "https://h.com/a/b?x=1#f"
    cases = {
        "/c": "https://h.com/c", "c": "https://h.com/a/c", "../c": "https://h.com/c", "./c/../d/": "https://h.com/a/d/",
        "?z=2&a=1": "https://h.com/a/b?a=1&z=2", "#top": "https://h.com/a/b?x=1", "//O.com/x": "https://o.com/x",
        "HTTP://O.com": "http://o.com/", "mailto:a@b.c": None, "javascript:void(0)": None, "/für": "https://h.com/f%C3%BCr",
        "/..": "https://h.com/",
    }
    got = values(spark, [(base, h) for h in cases], urls.resolve_link(F.col("b"), F.col("h")), "b string, h string")
    assert dict(zip(cases, got)) == cases


def test_deny_list(spark):
    cases = ["https://docs.js.org/x", "https://a.com/loginhelp", "https://a.com/X.PDF", "https://a.com/page"]
    assert values(spark, cases, is_denied(F.col("x"))) == [True, True, True, False]
    assert values(spark, cases, is_denied(F.col("x"), case_sensitive=True)) == [True, True, False, False]


def test_entities(spark):
    cases = ["a &amp;lt; b", "&#65;&#x42;", "&copy; &middot; &nope; & x", "no", "", "&#0; &#99999999;", "&hellip;&apos;", "&#x1F600;"]
    expected = ["a &lt; b", "AB", "© · &nope; & x", "no", "", "&#0; &#99999999;", "…'", "😀"]
    assert values(spark, cases, text.decode_entities(F.col("x"))) == expected


def test_entities_agree_with_the_standard_library(spark):
    cases = [f"x&{name};y" for name in text.ENTITIES]
    assert values(spark, cases, text.decode_entities(F.col("x"))) == [html.unescape(c) for c in cases]


def test_trim_and_length(spark):
    assert values(spark, [" ﻿ a b　\n"], text.trim_blank(F.col("x"))) == ["a b"]
    assert values(spark, ["a😀", "ü", ""], text.utf16_length(F.col("x"))) == [3, 1, 0]


def test_sentences(spark):
    cases = ["Heading", "One. Two.", "One. Two", 'He said "No." Then left.', "v1.2 is out"]
    assert values(spark, cases, text.sentence_count(F.col("x"))) == [1, 2, 2, 2, 1]


def test_article_parts(spark):
    page = (
        '<html><head><title>T &amp; U</title><meta name="description" content="About &lt;it&gt;"></head><body>'
        '<script>var a="<title>no</title><article>";</script><nav>menu</nav>'
        '<article><h1>Head</h1><p>One <b>bold</b><p>Two</article><footer>foot</footer></body></html>'
    )
    clean = text.drop_scripts(F.col("x"))
    article = text.article_html(clean)
    assert values(spark, [page], text.page_title(clean)) == ["T & U"]
    assert values(spark, [page], text.article_summary(clean, article)) == ["About <it>"]
    assert values(spark, [page], text.article_text(article))[0].split() == ["Head", "One", "bold", "Two"]
    assert "\n\n" not in values(spark, [page], text.article_text(article, block_breaks=False))[0]
    bare = "<p>First words</p><p>More</p>"
    assert values(spark, [bare], text.article_summary(clean, article)) == ["First words"]
    assert values(spark, [bare, ""], text.page_title(clean)) == ["", ""]


def test_citations(spark):
    assert values(spark, ["Spark [12] is"], text.strip_citations(F.col("x"))) == ["Spark  is"]


def test_highlight(spark):
    assert values(spark, ["spark"], word_variants(F.col("x"))) == [["spark", "Spark", "SPARK"]]
    assert values(spark, ["Ab  c+"], word_variants(F.col("x"))) == [["Ab", "c+", "AB", "ab", "C+"]]
    marked = highlight(F.col("t"), F.col("q"))
    assert values(spark, [("Spark and spark", "spark")], marked, "t string, q string") == ["<b>Spark</b> and <b>spark</b>"]


def test_fuzzy_columns(spark):
    pairs = [("Spark SQL guide", "spark sql"), ("other", "spark sql"), ("x", "")]
    assert values(spark, pairs, contains_ratio(F.col("t"), F.col("q")), "t string, q string") == [100, 0, 0]
    assert values(spark, pairs, partial_levenshtein(F.col("t"), F.col("q")), "t string, q string")[::2] == [100, 0]


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql(
        "SELECT host_of('https://WWW.h.com/a') h, site_of('www.a.h.com') s, strip_citations('a [1]') c,"
        " breadcrumb_of('https://h.com/a/b/c') b, partial_ratio('spark sql guide', 'spark sql') p"
    ).first()
    assert tuple(row) == ("www.h.com", "h.com", "a ", "h.com › a › b", 100)


def test_merging_takes_linear_time(spark):
    import time

    from pagetrove.operators.chunking import merge_single_sentences

    took = []
    for n in (40_000, 40_000, 80_000):
        df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("Line "), i.cast("string"))).alias("p"))
        started = time.time()
        assert df.select(F.size(merge_single_sentences(F.col("p"))).alias("n")).first().n == n // 2
        took.append(time.time() - started)
    assert took[2] < 4 * took[1] + 2


def test_more_entities(spark):
    from pagetrove.functions.text import decode_entities

    cases = {"&#000000039;": "'", "&#150;": "\u2013", "&#x96;": "\u2013", "&equals;&hellip;&NotEqualTilde;": "=\u2026\u2242\u0338", "&nosuch; &#xFFFFFFF;": "&nosuch; &#xFFFFFFF;"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.d for r in df.select("t", decode_entities(F.col("t")).alias("d")).collect()} == cases


def test_sql_breadcrumb_equals_column(spark):
    from pagetrove.functions.register import register_functions
    from pagetrove.functions.urls import breadcrumb

    register_functions(spark)
    urls = ["https://h.com/für/x", "https://h.com/a b/c.html", "https://h.com", "https://h.com/" + "ü" * 20 + "/b", "nowhere"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert all(r.a == r.b for r in df.select(breadcrumb(F.col("url")).alias("a"), F.expr("breadcrumb_of(url)").alias("b")).collect())


@pytest.mark.parametrize("tag, found", [
    ("<meta name='description' content='It&#39;s'>", "It's"),
    ("<meta content='single' name=\"description\">", "single"),
    ("<meta name=description content=\"bare name\">", "bare name"),
    ("<meta property=\"x\" content=\"other\"><meta content=\"a 'b'\" name='description' />", "a 'b'"),
    ("<meta name=\"description\" content=''>", None),
])
def test_meta_description(spark, tag, found):
    got = values(spark, [tag], text.article_summary(F.col("x"), F.lit("")))
    assert got == [found]


@pytest.mark.parametrize("tag", [
    "<meta property='og:site_name' content='A & B'>", "<meta content=\"A &amp; B\" property=\"og:site_name\">",
    "<META CONTENT='A & B' id=x PROPERTY=og:site_name>",
])
def test_meta_site_name(spark, tag):
    assert values(spark, [tag, "<meta property='og:site' content='no'>"], text.article_sitename(F.col("x"))) == ["A & B", None]


def test_dense_text(spark):
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Section number {i} of the site menu</a></li>" for i in range(20)) + "</ul>"
    first = "A paragraph of the story that is long enough to count, with &amp; and <b>bold</b> words in it."
    second = "Another paragraph, with <a href='/x'>one link</a> among many words that are not part of any link at all."
    page = (f"<html><head><title>T</title></head><body><!-- <p>{first}</p> --><div>{menu}</div><div class=story><h2>Head</h2><p>{first}<p>{second}</div>"
            f"<div>Short</div>{menu}<p>Copyright</p></body></html>")
    dense = text.dense_text(text.drop_scripts(F.col("x")))
    got = values(spark, [page, "", "<p>few words</p>", menu, first], dense)
    plain = "A paragraph of the story that is long enough to count, with & and bold words in it."
    assert got[0] == plain + "\n\nAnother paragraph, with one link among many words that are not part of any link at all."
    assert got[1:] == ["", "", "", plain]


def test_dense_text_takes_the_best_run(spark):
    block = lambda n: "<p>" + "x" * n + "</p>"
    cases = [block(60) + block(20) + block(90), block(60) + block(1) + block(1) + block(62), block(60) + block(30) + block(50), block(50) * 2]
    dense = text.dense_text(F.col("x"))
    # worth 20, -20, 50; 20, -39, -39, 22; 20, -10, 10 (the first run to be the best counts); 10, 10
    want = ["\n\n".join("x" * n for n in run) for run in ([60, 20, 90], [62], [60], [50, 50])]
    assert values(spark, cases, dense) == want
