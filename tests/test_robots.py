"""Rules of hosts, by hand and against plain Python."""

from lodestone.operators import robots


def test_rules_of_a_file():
    text = "User-agent: A\nUser-agent: B\nDisallow: /x # no\nAllow: /x/y\n\nUser-agent: *\nDisallow:\nCrawl-delay: 2.5\nnonsense\nCrawl-delay: soon"
    got = [(r["agent"], r["path"], r["allow"], r["delay"]) for r in robots.rules_in(text)]
    assert got == [("a", "/x", False, None), ("b", "/x", False, None), ("a", "/x/y", True, None), ("b", "/x/y", True, None), ("*", None, None, 2.5)]
    assert robots.rules_in(None) == robots.rules_in("Disallow: /before any agent") == []


def test_the_longest_rule_decides(spark):
    files = spark.createDataFrame([("H.org", "User-agent: *\nDisallow: /\nUser-agent: me\nDisallow: /a\nAllow: /a/b\nAllow: /c\nDisallow: /c\nCrawl-delay: 3"), ("free.org", None)], "host string, robots string")
    urls = ["http://h.org/a", "https://u@h.org:80/a/b?q#f", "http://H.ORG", "http://h.org/c", "http://free.org/a", "http://none.org/", None, "no address", ""]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS rules_")
    told = {r.page_id: r for r in robots.judged(pages, files, "Me").collect()}
    assert [told[k].allowed for k in range(9)] == [False, True, True, True, True, True, False, False, False]
    assert [told[k].rule for k in range(4)] == ["/a", "/a/b", None, "/c"] and told[1].path == "/a/b?q" and told[2].path == "/"
    assert [told[k].delay for k in (0, 4, 5)] == [3.0, robots.DELAY, robots.DELAY]
    assert not any(r.allowed for r in robots.judged(pages, files, "another").filter("host = 'h.org'").collect())
    plan = sorted((r.host, r.place, r.at, r.page_id) for r in robots.schedule(robots.judged(pages, files, "me"), ["url", "page_id"]).collect())
    assert plan == [("free.org", 0, 0.0, 4), ("h.org", 0, 0.0, 2), ("h.org", 1, 3.0, 3), ("h.org", 2, 6.0, 1), ("none.org", 0, 0.0, 5)]


def test_empty_tables(spark):
    files, pages = spark.createDataFrame([], "host string, robots string"), spark.createDataFrame([], "page_id long, url string")
    assert robots.judged(pages, files).collect() == [] == robots.schedule(robots.judged(pages, files), ["page_id"]).collect()
