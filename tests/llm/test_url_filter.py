import pytest

from textrisk.llm.common import table
from textrisk.llm.url_filter import BLOCKED, judge_urls, labelled_urls, train_url_model

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = []
    for rule, says in RULES:
        zone, _, start = rule.partition("/")
        if (host == zone or host.endswith("." + zone)) and path.startswith("/" + start):
            fits.append((len(rule), rule, says))
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


URLS = [None, "", "no scheme/x", "http://", "http://A.Example.ORG/es/1?x#y", "https://example.org/en/17", "https://xexample.org/en/17",
        "http://org/", "http://a.org", "http://b.com/fr/", "http://b.com/de/4#z", "http://b.com?de=/de/", "http://b.com#/fr/",
        "ftp://c.net/p://q", "http://É.com/fr/É", "http://casino-bonus.net/en/3", "http://library.net/en/3", "http://" + "a" * 20_000 + ".net/"]


@pytest.fixture(scope="module")
def model(spark):
    return train_url_model(spark)


def test_parts_and_rules_match_brute_force(spark, model):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(0, URLS[4], "clash")],
                                  "page_id long, url string, verdict string")
    got = judge_urls(pages, model).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule, says = brute(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == says if says else r.verdict == ("block" if r.p_block > 0.5 else "allow")


def test_model_separates_unseen_sites(spark, model):
    bad = ["adult-cams", "casino-spin", "cheap-pharma", "pornstar", "bet-online", "free-poker"]
    good = ["theron", "gardens", "science.news", "m.library", "blog.thering", "docs.museum"]
    pages = spark.createDataFrame([(i, f"https://{h}.example.net/en/77") for i, h in enumerate(bad + good)], "page_id long, url string")
    p = [r.p_block for r in judge_urls(pages, model).orderBy("page_id").collect()]
    assert sum(b > g for b in p[:6] for g in p[6:]) >= 27  # of 36 pairs


def test_labels_fit_their_own_table(spark, model):
    rows = [(i, f"http://{h}{p}", y) for i, (h, p, y) in enumerate(labelled_urls())]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, y int"), model, rules=())
    assert got.where("(verdict = 'block') <> (y = 1)").count() == 0 and len(BLOCKED) > 20


def test_empty_and_driver_table(spark, model):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    assert judge_urls(pages.limit(0), model).count() == 0
    got = judge_urls(pages, model)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        host, path, rule, says = brute(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and (says is None or r.verdict == says)


UNWANTED = ("casinonight.biz", "poker-club.site", "adultvideos.example.net", "sex-contacts.eu", "cheap-viagra.shop", "torrentfiles.to",
            "best-betting.club", "spam-mailers.us", "free-porn.tv", "payday-money.biz")
ORDINARY = ("gardeners.eu", "library.town.ca", "www.physics-lectures.at", "historymuseum.nl", "weather-maps.ch", "railwaystation.it",
            "recipes-and-cooking.us", "www.universitypress.pl", "woodland-walks.example.net", "teachers-college.au")


def test_verdicts_at_the_threshold_on_sites_outside_the_table(spark, model):
    hosts = {h.lower() for h, _, _ in labelled_urls()}
    words = {w for h in hosts for w in h.split(".")}
    assert not any(h in hosts or h.split(".")[0] in words - {"www"} for h in UNWANTED + ORDINARY)
    rows = [(i, f"http://{h}/fr/51", h in UNWANTED) for i, h in enumerate(UNWANTED + ORDINARY)]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, bad boolean"), model).collect()
    wrong = [(r.host, r.p_block) for r in got if (r.verdict == "block") != r.bad and r.rule is None]
    assert len(wrong) <= 4, wrong  # of 20


def test_no_site_of_the_driver_tables_is_in_the_table(spark):
    table_hosts = {w for h, _, _ in labelled_urls() for w in h.split(".")} - {"www", "m", "blog", "com", "net", "org"}
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        for r in table(spark, f"/root/testdata/{sf}", "pages").selectExpr("split(url, '/')[2] AS host").distinct().collect():
            assert not table_hosts & set(r.host.split(".")), r.host
