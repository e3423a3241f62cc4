from kinfold.llm import urls


def verdicts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict, r.by_alias) for r in urls.filter_urls(pages).collect()}


def test_rules_hosts_and_paths(spark):
    found = verdicts(spark, [(1, "HTTP://A.Example.NET/en/x?y#z", ""), (2, "http://example.net/de", None), (3, "http://badexample.com/de/", ""), (4, "x://example.com/de/a", ""), (5, "http://foo.org/fr", ""), (6, "http://foo.org/fr/", ""), (7, None, "<link rel=canonical href='http://a.net/'>"), (8, "no scheme/net/", ""), (9, "http://a.net", ""), (10, "http://a.net?x=/", "")])
    assert found == {
        1: ("a.example.net", "/en/x", "example.net/en/", "allow", False), 2: ("example.net", "/de", "net/", "block", False),
        3: ("badexample.com", "/de/", None, "allow", False), 4: ("example.com", "/de/a", "example.com/de/", "block", False),
        5: ("foo.org", "/fr", None, "allow", False), 6: ("foo.org", "/fr/", "org/fr/", "allow", False), 7: ("", "", None, "allow", False),
        8: ("", "", None, "allow", False), 9: ("a.net", "", None, "allow", False), 10: ("a.net", "", None, "allow", False),
    }


def test_decisions_travel_and_allow_wins(spark):
    link = lambda to: f'<LINK href="{to}" rel="canonical">'
    found = verdicts(spark, [
        (1, "http://a.io/1", link("http://b.io/2")), (2, "https://b.io/2#top", '<meta content="0; URL=http://bad.net/x" http-equiv=Refresh>'),
        (3, "http://c.io/3", "<link rel='canonical' href='//bad.net/y'>"), (4, "http://c.io/dir/4", '<link rel=canonical href="/3">'),
        (5, "http://c.io/dir/5", '<link rel=canonical href="4">'), (6, "http://d.io/", link("http://ok.org/fr/a")), (7, "http://e.net/q", link("http://d.io/")),
        (8, "http://f.io/", '<link rel=stylesheet href="http://bad.net/x">'), (9, "http://a.io/1", None), (10, "http://d.io", link("http://d.io/")),
    ])
    assert {i: v[3:] for i, v in found.items()} == {1: ("block", True), 2: ("block", True), 3: ("block", True), 4: ("block", True), 5: ("block", True), 6: ("allow", True), 7: ("block", False), 8: ("allow", False), 9: ("block", True), 10: ("allow", True)}


def test_hot_target_repeats_and_empty(spark):
    rows = [(i, f"http://h{i}.io/", '<link rel="canonical" href="http://hub.net/p">') for i in range(200)] + [(0, "http://h0.io/", "")] * 2
    found = verdicts(spark, rows)
    assert all(v[3:] == ("block", True) for v in found.values())
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
