"""URL rules against a direct evaluation."""

from __future__ import annotations

import re

import pytest
from helpers import clashing
from oracle_compare import compare, duck

import __spark_entry__ as E
from pitlane.llm import url_filter as U
from pitlane.llm.queries import ORACLE

URLS = [
    None, "", "no scheme", "http://Example.ORG/es/1", "https://a.b.example.org/en/148?x=/es/", "http://notexample.org/es/", "x://com/fr/", "http://com", "http://x.com/FR/", "http://x.com/fr/",
    "http://x.com/de/#a", "http://spam-farm.example.com/en/1", "http://www.spam-farm.net", "http://spam-farms.net/", "ftp://h://i/j", "http://x.org?y", "http://x.org/?y", "http://x.com/fr/" + "a/" * 20_000,
]


def direct(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


@pytest.mark.parametrize("bound", [0, 20_000])
def test_rules_against_direct_matching(spark, monkeypatch, bound):
    monkeypatch.setattr(U, "BROADCAST_RULES", bound)
    rules = [U.domain_rule(r, v) for r, v in [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow")]]
    rules += [U.Rule("||spam-farm.", "block", 1), U.Rule("*farm*", "allow", 2), U.Rule("/de^", "block", 1)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS + URLS[:5])], "page_id long, url string")
    got = {r.page_id: r for r in U.judge(clashing(df).withColumnsRenamed({"n": "layer", "term": "a.b"}), rules).collect()}
    assert len(got) == len(URLS) + 5 and got[0]["a.b"] == "x" and len(set(got[0].asDict())) == len(got[0])
    for i, u in enumerate(URLS + URLS[:5]):
        host, path = direct(u)
        fits = [r for r in rules if re.search(U.to_regex(r.pattern).replace("\\x{", "\\x").replace("}", ""), host + path)]
        best = min(fits, key=lambda r: (r.layer, -len(r.name or r.pattern)), default=None)
        assert (got[i].host, got[i].path) == (host, path)
        assert (got[i].rule, got[i].verdict) == ((best.name or best.pattern, best.verdict) if best else (None, None)), u


def test_tokens_that_a_match_must_hold():
    assert U.literal_tokens("||example.org/en/1") == ["en", "example", "org"]
    assert U.literal_tokens("*farm*") == []
    assert U.literal_tokens("/ads/*") == ["ads"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(df, [U.domain_rule("org/", "allow")]).count() == 0


def test_op7_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    ok, msg = compare(E.queries()["op7_url_rules"](spark, sf), ORACLE["op7_url_rules"], duck(sf))
    assert ok, msg


def test_thousands_of_rules_run_few_expressions(spark):
    """Rules with wildcards, separators and no token at all: the same verdicts as trying every rule, on a few candidates a URL."""
    from pyspark.sql import functions as F

    rules = [U.Rule(f"||site{i}.example.com/path{i % 7}/*", "block", i % 2) for i in range(2000)]
    rules += [U.Rule(f"/ad{i}^", "block", 2) for i in range(1000)] + [U.Rule(f"*banner{i}*", "allow", 2) for i in range(300)]
    rules += [U.domain_rule(f"zone{i}.net/", "allow") for i in range(200)] + [U.Rule("*.*^^", "block", 9)]
    urls = [f"https://{'www.' * (j % 2)}site{j * 7}.example.com/path{j % 5}/ad{j % 40}/x{j}?q" for j in range(150)]
    urls += [f"http://a{j}.zone{j % 30}.net/common/mybanner{j % 9}x/" for j in range(50)] + ["http://x.y/a//"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    regexes = [(r, re.compile(U.to_regex(r.pattern).replace("\\x{", "\\x").replace("}", ""))) for r in rules]
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge(df, rules).collect()}
    for i, u in enumerate(urls):
        fits = [r for r, x in regexes if x.search("".join(direct(u)))]
        best = min(fits, key=lambda r: (r.layer, -len(r.name or r.pattern), r.name or r.pattern), default=None)
        assert got[i] == ((best.name or best.pattern, best.verdict) if best else (None, None)), u
    host, path = U.host_and_path(F.col("url"))
    targets = df.select(host.alias("host"), path.alias("path")).distinct().withColumn("target", F.concat("host", "path"))
    tried = U.candidates(targets, U.rule_index(spark, rules, targets), rules).count()
    assert tried < 400 * len(urls) < len(rules) * len(urls)  # the 301 rules without a whole literal token, and a few more
