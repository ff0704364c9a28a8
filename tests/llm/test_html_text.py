import html as entities
import re

import pytest

from textrisk.llm.common import table
from textrisk.llm.html_text import best_region, extract, main_text, op2_html_extraction, train_weights

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def weights(spark):
    return train_weights(table(spark, SF, "pages"))


def test_driver_pages_give_their_articles(spark):
    got = {r.page_id: r for r in op2_html_extraction(spark, SF).collect()}
    for r in table(spark, SF, "pages").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = [" ".join(entities.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_parts_that_are_no_main_text(weights):
    page = ("<html><head><title>T t</title><style>p {}</style><script>var a = '<p>no</p>';</script></head><body>"
            "<header>Site name</header><nav><ul><li><a href=x>Home</a></li><li>About us</li></ul></nav>"
            "<div class='cookie-notice'>We use cookies here</div><div class=\"ad\">Buy this thing now</div>"
            "<article><h1>Head &amp; line</h1><p>First  words\n of <b>the</b> text.</p><!-- hidden <p> -->"
            "<aside>Side bar words</aside><form><label>Mail</label><input name=q></form>"
            "<p>Second&nbsp;part &lt;here&gt;.</p><div id=comments><p>A reader says things</p></div></article>"
            "<div class=sidebar><p>More links</p></div><footer>&copy; 2020 Somebody</footer></body></html>")
    assert main_text(page, weights) == "Head & line\nFirst words of the text.\nSecond part <here>."


def test_edges(weights):
    assert main_text(None, weights) == "" and main_text("", weights) == "" and main_text("<p></p><br>", weights) == ""
    assert main_text("no markup at all", weights) == "no markup at all"
    assert main_text("<article><p>cut off in the mid", weights) == "cut off in the mid"
    assert main_text("<article><p>a < b and c</p></article>", weights) == "a < b and c"
    long = "<article>" + "<p>word and word</p>" * 20_000 + "</article>"
    assert main_text(long, weights).count("\n") == 19_999


def test_region_is_the_maximum_sum():
    scores = [1, -2, 3, 4, -1, 5, -9, 6, 0]
    sums = {(a, b): sum(scores[a:b]) for a in range(9) for b in range(a + 1, 10)}
    a, b = best_region(scores)
    assert sums[a, b] == max(sums.values()) and best_region([-1.0, -2.0]) == (0, 0) and best_region([]) == (0, 0)


def test_null_rows_repeats_and_empty_table(spark, weights):
    pages = spark.createDataFrame([(1, None, "n"), (None, "<p>x y</p>", "n"), (None, "<p>x y</p>", "n")],
                                  "page_id long, html string, text string")
    got = sorted((r.page_id is None, r.text) for r in extract(pages, weights).collect())
    assert got == [(False, ""), (True, "x y"), (True, "x y")]
    empty = pages.limit(0)
    assert extract(empty, train_weights(empty)).count() == 0


LEAD = "<article><h1>Title here</h1><p>A short lead of eight words in all.</p>"
KEPT = "Title here\nA short lead of eight words in all."


def test_links_lists_short_articles_and_long_comments(weights):
    assert main_text(LEAD + "<p>More <a href=x>linked words</a> follow.</p></article>", weights) == KEPT + "\nMore linked words follow."
    items = "".join(f"<li><a href=x>point number {i}</a></li>" for i in range(9))
    assert main_text(LEAD + f"<ul>{items}</ul></article>", weights).split("\n")[2:] == [f"point number {i}" for i in range(9)]
    long = "<p>" + "reader words " * 60 + "</p>"
    assert main_text(LEAD + f"</article><div class=comments>{long}</div>", weights) == KEPT
    assert main_text(LEAD + f"</article><div>{long}</div>", weights) == KEPT
    assert main_text(LEAD + f"<aside>{long}</aside><p>The end.</p></article>", weights) == KEPT + "\nThe end."
    plain = "<div><h1>Title</h1><p>Some text <a href=x>with a link</a> in it.</p><ul><li>one</li><li>two</li></ul></div>"
    assert main_text(f"<body>{plain}<div id=comments>{long}</div></body>", weights) == "Title\nSome text with a link in it.\none\ntwo"


def test_dropped_elements_end_where_html_says(weights):
    assert main_text('<article><p class="notice">x<p>a</p><p>b</p></article>', weights) == "a\nb"
    assert main_text('<article><p>a</p><ul><li class="share">x<li>b</ul><p>c</p></article>', weights) == "a\nb\nc"
    assert main_text('<article><div><div class="ad">x</div><p>a</p></div><p>b</article>', weights) == "a\nb"
    assert main_text('<article><p>a</p><svg width="1"/><p>b <button>x</button>c</p></article>', weights) == "a\nb c"
    assert main_text('<article><p>a</p><section><svg><path d="x"></section><p>b</p></article>', weights) == "a\nb"
    assert main_text('<article><p>a <span class="ad">x <span>y</span> z</span> b</p></article>', weights) == "a b"


def test_ids_of_article_parts_are_kept(weights):
    for name, attr in (("h2", "social-impact"), ("section", "related-work"), ("div", "comments-on-method"), ("p", "notice-period"), ("h2", "related")):
        assert main_text(f'<article><p>a</p><{name} id="{attr}">kept</{name}><p>b</p></article>', weights) == "a\nkept\nb"
    for name in ("related-posts", "comment-list", "social share", "x ad-slot-3", "cookie-notice"):
        assert main_text(f'<article><p>a</p><div class="{name}">x</div><p>b</p></article>', weights) == "a\nb"


def test_labelled_pages_are_found_before_sampling(spark):
    rows = [(i, "<body><p>plain page</p></body>") for i in range(3000)] + [
        (-1, "<body><div class=zz>out of it</div><article><p>in it</p></article></body>")]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    assert train_weights(pages, max_pages=5)["in div.zz"] < 0.1
    with pytest.warns(UserWarning, match="no page marks"):
        assert train_weights(pages.where("page_id >= 0"), max_pages=5) == {}
