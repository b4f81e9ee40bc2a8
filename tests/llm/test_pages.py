"""Wrappers and main text of pages."""

import json
import random

import pytest
from pyspark.sql import functions as F

from wirefold.llm import wrappers
from wirefold.llm.wrappers import align, digest, extract, infer, items_of, main_text, pattern

PAGE = ('<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
        '<nav><ul><li><a href="/x">x</a></li><li>y</ul></nav><!-- ad --><div class="ad">buy</div>'
        '<article><h1>{0}</h1><p><b>{1}<br><p>{2}</p></article><footer>&copy; z</footer>')


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain <b>te</b>xt", "plain text"), ("<!-- open <p>x", ""), ("<p>a<p>b", "a\nb"),
    ("a &lt; b &amp; c&nbsp;d &#233;&eacute &am", "a < b & c d éé &am"), ("a<br>b", "a b"),
    ("<p> x \n y\t</p>", "x y"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("<p>a<p", "a"),
    ("<script>x<p>no</p>", ""), ("<SCRIPT>n</SCRIPT>yes", "yes"), ('<p title="a>b">q</p>', "q"),
    ("<ul><li>one<li>two</ul>", "one\ntwo"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<body><header>h</header><main><p>m</p></main><aside>s</aside>", "m"),
    ('<div class="cookie-notice">n</div><p>t</p><form>f</form><div id="comments"><p>c</p></div>', "t"),
    ('<article><header><h1>H</h1><i>by</i></header><p>x<div role="navigation">n</div><p>y</article>', "H\nx\ny"),
    ('<article><p>a</p><div class="comments"><p>c</p></div></article><article class="comment">d</article>', "a"),
    ('<div class="has-sidebar"><p>story</p></div>', "story"), ('<div class="layout header-fixed"><p>s</p></div>', "s"),
    ('<div class="search-results"><p>s</p></div>', "s"), ("<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be", "let x=1 be"),
    ('<article><div class="article-header"><h1>H</h1><i>by</i></div><p>x</article>', "H\nx"),
    ("</p></div>x</article>", "x"), ("<textarea>no</textarea><select><option>no</select>yes", "yes")])
def test_blocks(page, text):
    assert main_text(page) == text


def test_pages_of_one_template_fold_to_one_wrapper():
    one, two = (items_of(PAGE.format(*v)) for v in (("A", "b", "c"), ("D", "e", "f")))
    found = pattern(align(one, two))
    assert "(<li>#</li>)+" in found or "<li>" in found
    assert "<h1>#</h1>(<p>#</p>)+" in found and "(" in found
    assert main_text(PAGE.format("A &amp; B", "b", "c")) == "A & B\nb\nc"


def test_mismatches_turn_optional_and_repeats_turn_groups():
    found = pattern(align(items_of("<h2>a</h2><p>b</p><h2>c</h2><p>d</p>"), items_of("<div>x</div><h2>e</h2><p>f</p>")))
    assert "(<h2>#</h2><p>#</p>)" in found.replace("+", "") and "<div>" in found and "?" in found
    same = align(items_of("<p>a</p><i>k</i>"), items_of("<p>a</p><i>m</i>"))
    assert "=" in pattern(same) and "#" in pattern(same)


def test_deep_and_wide_markup_stay_bounded():
    deep = items_of("<div>" * 5000 + "x" + "</div>" * 5000)
    assert len(json.dumps(deep)) < 10_000
    wide = items_of("".join(f"<x{i}>a</x{i}>" for i in range(3000)))
    assert align(wide, items_of("<p>x")) == [[wrappers.ANY, "*", None, [], 0]]
    assert main_text("<div>" * 5000 + "x") == "x"


def rows(spark, pages):
    return spark.createDataFrame(pages, "page_id bigint, url string, html string")


def test_template_text_outside_articles_is_dropped_by_the_wrapper(spark):
    pages = rows(spark, [(i, "http://h.com/a", f"<div>Welcome to our site</div><div><p>story {i}</p></div>")
                         for i in range(5)] + [(9, "http://one.com/", "<div>Welcome to our site</div><p>z</p>")])
    got = {r["page_id"]: r["text"] for r in digest(pages.repartition(3)).collect()}
    assert got[0] == "story 0" and got[9] == "Welcome to our site\nz"


def test_wrappers_do_not_depend_on_partitions(spark):
    pages = rows(spark, [(i, f"http://h{i % 2}.com/", PAGE.format(f"t{i}", "b", "c")) for i in range(30)])
    found = [sorted(infer(pages.repartition(n)).collect()) for n in (1, 7)]
    assert found[0] == found[1]
    assert [(r["host"], r["pages"]) for r in found[0]] == [("h0.com", 15), ("h1.com", 15)]


def test_edges(spark):
    pages = rows(spark, [(1, None, "<p>a</p>"), (2, "http://x.com", None), (3, "http://x.com", ""),
                         (4, "http://x.com", "<p>" + "w " * 200_000), (4, "http://x.com", "<p>b")])
    got = digest(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"], r["n_chars"]) for r in got.collect()) == [(1, 1), (2, 0), (3, 0), (4, 1), (4, 399_999)]
    assert digest(pages.limit(0)).count() == 0
    named = pages.withColumnRenamed("page_id", "_host")
    assert extract(named, infer(named)).columns == ["_host", "url", "html", "text"]


def texts(spark, pages):
    return {r["page_id"]: r["text"] for r in digest(rows(spark, pages).repartition(3)).collect()}


def test_text_of_one_page_is_not_shared_by_all(spark):
    pages = [(i, "http://h.com/", f"<div>Welcome</div><p>story {i}</p>" + ("<blockquote>said once</blockquote>" * (i == 2)))
             for i in range(6)]
    got = texts(spark, pages)
    assert got[2] == "story 2\nsaid once" and got[3] == "story 3"


def test_copies_of_one_page_share_nothing(spark):
    got = texts(spark, [(i, "http://h.com/", f"<div>Welcome</div><p>story</p><script>{i}</script>") for i in range(5)])
    assert set(got.values()) == {"Welcome\nstory"}


def test_shared_text_of_a_host_with_many_different_siblings(spark):
    def letters(n):
        return "".join(chr(97 + int(d)) for d in str(n))
    pages = [(i, "http://h.com/", "<div>Welcome</div>" + "".join(
        f"<p class='k{letters(200 * i + k)}'>t {i} {k}</p>" for k in range(200))) for i in range(5)]
    found = infer(rows(spark, pages)).first()
    got = texts(spark, pages)
    assert wrappers.ANY in found["wrapper"]
    assert all(t.startswith(f"t {i} 0\n") and t.count("\n") == 199 for i, t in got.items())


def test_shared_text_inside_articles_is_dropped(spark):
    page = "<article><p>story {0}</p><div class='bar'><p>Read more on h</p></div></article><p>below {0}</p>"
    got = texts(spark, [(i, "http://h.com/", page.format(i)) for i in range(5)] + [(9, "http://one.com/", page.format(9))])
    assert got[0] == "story 0" and got[9] == "story 9\nRead more on h"


SITE = ("<html><body><div class='kq'><div><p>teaser {0} of something else</p></div></div><div class='sidebar wide'><div class='zz'><h2>Title {0}</h2>"
        "<p>" + "the story {0} goes on and on " * 12 + "</p><div class='ad'><p>buy {0}</p></div></div></div><section class='vw'><div>end {0}</div></section></body></html>")


def test_the_wrapper_decides_where_the_content_is(spark):
    """Template that varies, under names that no list has; content under a listed name."""
    pages = rows(spark, [(i, "http://h.com/", SITE.format(f"n{i}")) for i in range(6)])
    found = infer(pages)
    assert found.first()["region"] == ["html", "body", "div.sidebar.wide", "div.zz"]
    got = {r["page_id"]: r["text"] for r in extract(pages, found).collect()}
    assert got[2].split("\n") == ["Title n2", ("the story n2 goes on and on " * 12).strip()]
    empty = found.withColumn("region", F.array().cast("array<string>")).withColumn("fixed", F.array().cast("array<bigint>"))
    without = {r["page_id"]: r["text"] for r in extract(pages, empty).collect()}
    assert without[2] == "teaser n2 of something else\nend n2"


def test_pages_without_the_region_and_hosts_with_few_pages(spark):
    pages = [(i, "http://h.com/", SITE.format(f"n{i}")) for i in range(6)] + [
        (20, "http://h.com/", "<main><p>another kind of page</p></main><p>x</p>"),
        (30, "http://one.com/", SITE.format("k")), (31, "http://one.com/", SITE.format("l"))]
    got = texts(spark, pages)
    assert got[20] == "another kind of page" and got[30] == "teaser k of something else\nend k"
    assert got[3].startswith("Title n3\nthe story n3") and "buy" not in got[3]


def test_no_region_where_nothing_holds_nearly_all(spark):
    short = "<body><div class='a'><p>one {0} two</p></div><div class='b'><p>three {0} four</p></div></body>"
    pages = rows(spark, [(i, "http://h.com/", short.format(i)) for i in range(5)])
    assert infer(pages).first()["region"] == []
    assert {r["text"] for r in digest(pages).where("page_id = 3").collect()} == {"one 3 two\nthree 3 four"}
    plain = "<body><h1>t {0}</h1><div class='lede'><p>lede {0}</p></div><div class='b'><p>" + "words {0} " * 80 + "</p></div></body>"
    pages = rows(spark, [(i, "http://h.com/", plain.format(i)) for i in range(5)])
    assert digest(pages).first()["text"].startswith("t ") and infer(pages).first()["region"] == []


def test_wide_levels_have_the_region_that_narrow_ones_have(spark):
    """Hundreds of siblings that differ from page to page, next to the content."""
    def page(i, wide):
        return ("<html><body><div class='kq'><p>teaser {0}</p></div>" + "".join(f"<x{k}y{i}></x{k}y{i}>" for k in range(wide))
                + "<div class='sidebar zz'><h2>Title {0}</h2><p>" + "the story {0} goes on " * 30 + "</p></div></body></html>").format(f"n{i}")
    for wide in (5, 450):
        found = infer(rows(spark, [(i, "http://h.com/", page(i, wide)) for i in range(5)])).first()
        assert found["region"] == ["html", "body", "div.sidebar.zz"], wide


def test_alignment_is_the_longest_common_run():
    """As a table of all suffixes gives it, ties decided alike."""
    rng = random.Random(3)

    def by_table(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        out, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out.append([a[i], "", None, [], 0])
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                out.append([a[i], "?", None, [], 0])
                i += 1
            else:
                out.append([b[j], "?", None, [], 0])
                j += 1
        return wrappers.fold(out + [[x, "?", None, [], 0] for x in a[i:] + b[j:]])
    for _ in range(300):
        a, b = ([rng.choice("pqrstuv") for _ in range(rng.randint(0, 14))] for _ in range(2))
        if a != b:
            made = [[[x, "", None, [], 0] for x in side] for side in (a, b)]
            assert wrappers.aligned(*made) == by_table(a, b)
