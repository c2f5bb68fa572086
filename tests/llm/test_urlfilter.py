import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hashloom.llm import urlfilter as U


def to_regex(glob):
    return re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob), re.S)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text("ab?*/.", max_size=12), min_size=1, max_size=40), st.lists(st.text("ab/.c", max_size=20), min_size=1, max_size=12))
def test_automaton_against_regular_expressions(globs, urls):
    got = U.Automaton(globs).match([u.encode() for u in urls])
    assert got.tolist() == [[bool(to_regex(g).fullmatch(u)) for g in globs] for u in urls]


def test_carry_between_words():
    long = "x" * 130
    got = U.Automaton([long, f"*{long}", f"{long}?", "*"]).match([long.encode(), b"y" + long.encode(), b""])
    assert got.tolist() == [[True, True, False, True], [False, True, False, True], [False, False, False, True]]
    assert U.Automaton(["a"]).match([]).shape == (0, 1)


CASES = [
    ("https://a.com/x", "a.com", "/x", "com/", "allow"),
    ("http://a.com", "a.com", "", None, "allow"),
    ("http://WWW.Example.COM/en/1?q#f", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
    ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
    ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("http://a.net/ES/1", "a.net", "/ES/1", None, "allow"),
    ("http://casino-x.org/a", "casino-x.org", "/a", None, "block"),
    ("http://a.org/A.ZIP", "a.org", "/A.ZIP", None, "block"),
    ("http://a.org?x://b.com/", "a.org", "", None, "allow"),
    ("a.com/x", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://é.com/ü", "é.com", "/ü", "com/", "allow"),
    ("http://" + "a" * 5000 + ".com/" + "b" * 5000, "a" * 5000 + ".com", "/" + "b" * 5000, "com/", "allow"),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(k, c[0], "html", 1) for k, c in enumerate(CASES)] * 2 + [(None, None, None, 0)], "page_id long, url string, rule string, host int")
    got = {r.page_id: tuple(r) for r in U.filter_urls(df).collect()}
    assert U.filter_urls(df).count() == 2 * len(CASES) + 1
    for k, c in enumerate(CASES):
        assert got[k] == (k, *c[1:])
    assert U.filter_urls(df.limit(0)).count() == 0


def test_longest_rule_wins_ties_to_first(spark):
    rules = (U.Rule("a.b", "/", "block"), U.Rule("b", "/xx", "allow"), U.Rule("a.b", "/x", "allow"), U.Rule("a.b", "/x", "block"))
    df = spark.createDataFrame([(1, "http://a.b/xxx")], "page_id long, url string")
    assert U.filter_urls(df, rules=rules).first().verdict == "allow"
    assert U.filter_urls(df, rules=(), blocked=()).first().verdict == "allow"


@pytest.mark.parametrize("n", [1, 7, 4096])
def test_batches(n):
    urls = [f"h{k}.com/{'p' * (k % 9)}".encode() for k in range(50)]
    a = U.Automaton(["*.com/*", "h?.com/pp*"])
    whole = a.match(urls)
    assert np.array_equal(np.concatenate([a.match(urls[k : k + n]) for k in range(0, 50, n)]), whole)


def test_rules_fit_the_host_only(spark):
    """A rule's host in the path (archives, redirects, proxies) is no host."""
    cases = [
        ("http://a.org/x.net/es/1", None, "allow"),
        ("http://archive.example.org/web/www.foo.com/a", None, "allow"),
        ("http://a.org/m.example.com/en/1", None, "allow"),
        ("http://b.org/casino/x.com/a", None, "block"),
        ("http://a.net/fr/x.com/a", "net/fr/", "block"),
        ("http://a.com/x.net/es/1", "com/", "allow"),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in U.filter_urls(df).collect()}
    assert [got[k] for k in range(len(cases))] == [c[1:] for c in cases]
