"""Regular expressions over names: every pattern tried on every name."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hostlens.operators import regex_search as RX

NAMES = ["Orthopoxvirus abatinomacacapox", "Lentivirus humimdef1", "Lentivirus simimdef", "Vesiculovirus indiana", "aaa", "AbC", "ab\nc", "Straße 7", "ΣΊΣΥΦΟΣ",
         "İstanbul virus", "ſpecial K virus", "x", "", "  ", "dot.star*", "Ébola virus", "(odd) [name]", None, "aaa"]
PATTERNS = ["pox", "LENTI", "^lentivirus (hum|sim)imdef", "def1?$", "a{3}", "a{2,}", "(ab)?c", "[aeiou]{2}", "vir[uo]s (ind|ab).*a$", ".*", "", "^$", "x|y|z", r"\bk\b",
            "stra(ss|ß)e", "σίσυφος", "istanbul", "special", "é", r"dot\.star\*", r"\(odd\) \[", "(?=ortho)orthopox", "(?!lenti)virus", "(a)(b)\\1?c", "a+?b", "[^a]b", "(unclosed", "*bad",
            "(?P<n>ves).*(?P=n)?", "(a|b|c|d|e|f)(a|b|c|d|e|f)(a|b|c|d|e|f)", "lentivirus|pox", None, "pox"]


def brute(patterns, names):
    out = set()
    for p in patterns:
        try:
            search = re.compile(p, re.IGNORECASE).search
        except (re.error, TypeError):
            continue
        out |= {(p, n) for n in names if n is not None and search(n)}
    return out


@pytest.mark.parametrize("at_once", [RX.TRIED_AT_ONCE, 1])
def test_every_pattern_on_every_name(spark, monkeypatch, at_once):
    monkeypatch.setattr(RX, "TRIED_AT_ONCE", at_once)
    rows = RX.regex_join(spark.createDataFrame([(p,) for p in PATTERNS], "pattern string"), spark.createDataFrame([(n,) for n in NAMES], "name string")).collect()
    assert {tuple(r) for r in rows} == brute(PATTERNS, NAMES) and len(rows) == len({tuple(r) for r in rows})


@settings(max_examples=400, deadline=None)
@given(st.from_regex(r"([abc]|\.|\[ab\]|\(ab\|c\)|\(a\|bc\)\?|b[?*+]|c\{2\}|a\{1,2\}|\^|\$|\\b){1,7}", fullmatch=True), st.text("abcA ", max_size=9))
def test_grams_lose_no_match(pattern, name):
    grams = RX.required_grams(pattern)
    try:
        found = re.compile(pattern, re.IGNORECASE).search(name)
    except re.error:
        assert grams is None
        return
    if found:
        text = RX.fold(name)
        assert any(all(g in text for g in alternative) for alternative in grams)


def test_grams_are_selective():
    assert RX.required_grams("abcd(e|fg)?") == [["abc", "bcd"], ["abc", "bcd", "cde"], ["abc", "bcd", "cdf", "dfg"]]
    assert RX.required_grams("ab.cd") == [["ab", "cd"]]
    assert RX.required_grams("x*") == [[]] and RX.required_grams("(") is None
    assert RX.required_grams("[ab]x") == [["ax"], ["bx"]]


def test_fallback_to_the_first_word(spark):
    taxa = spark.createDataFrame([(1, "Lentivirus humimdef1"), (2, "Lentivirus simimdef"), (3, "Vesiculovirus indiana"), (4, None)], "id long, n string")
    terms = spark.createDataFrame([("lentivirus (hum|zzz)",), ("LENTI\\w+ nothing",), ("(ves x",), ("ves.+ (",), (None,)], "term string")
    got = {(r["term"], r["match_level"], r["tax_id"]) for r in RX.name_regex_search(terms, taxa, "n", "id").collect()}
    assert got == {("lentivirus (hum|zzz)", "species", 1), ("LENTI\\w+ nothing", "genus", 1), ("LENTI\\w+ nothing", "genus", 2), ("ves.+ (", "genus", 3)}


def test_few_exchanges(spark):
    from hostlens.plans.registry import QUERIES, load_all
    load_all()
    df = QUERIES["name_regex_search"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") < 10


def test_empty(spark):
    none = spark.createDataFrame([], "pattern string, name string")
    some = spark.createDataFrame([("a", "a"), (".*", "b")], "pattern string, name string")
    assert RX.regex_join(none, some).count() == 0 == RX.regex_join(some, none).count()
