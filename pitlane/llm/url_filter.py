"""URL filter rules indexed by their rarest literal token.

A rule is a pattern over ``host || path``: ``||`` at the start anchors at the host or any of its
parent domains, ``*`` is any text, ``^`` a separator or the end, everything else is literal.
Literal tokens are the runs of ``[a-z0-9]`` that the pattern delimits on both sides, so any
URL that matches must hold each of them as a whole token. How often rule tokens
occur is counted over all distinct URLs; each rule is filed under its rarest one. A
URL's tokens fetch candidate rules by an equi-join, and only those pairs run a regular
expression. Rules without a literal token are filed under the empty token, which
every URL has. Among the rules that match, the lowest layer wins, then the longest pattern.

Null URLs and URLs without ``://`` have an empty host and path. Repeated URLs are judged once and
joined back to every row. An empty table gives no rows. Only the key and URL columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_RULES = 20_000  # rules; above this the index is joined by a shuffle


@dataclass(frozen=True)
class Rule:
    """``layer`` 0 goes before layer 1, and so on; ``name`` is what results show."""

    pattern: str
    verdict: str
    layer: int = 0
    name: str | None = None


def domain_rule(rule: str, verdict: str, layer: int = 0) -> Rule:
    """``host/path`` fits the host and its subdomains and paths that start with the path."""
    return Rule("||" + rule, verdict, layer, rule)


def to_regex(pattern: str) -> str:
    """The pattern as a regular expression over ``host || path``."""
    head = "^(?:[^/]*[.])?" if pattern.startswith("||") else ""
    parts = {"*": "(?s:.*)", "^": "(?:[^a-z0-9_.%-]|$)"}
    return head + "".join(parts.get(c) or (c if c.isalnum() else f"\\x{{{ord(c):x}}}") for c in pattern.removeprefix("||"))


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that a matching URL must hold whole."""
    body = pattern.removeprefix("||")
    anchored = pattern.startswith("||")
    found = set()
    for m in re.finditer(r"[a-z0-9]+", body):
        left = body[m.start() - 1] if m.start() else ("^" if anchored else "*")
        right = body[m.end()] if m.end() < len(body) else "*"
        if left != "*" and right != "*":
            found.add(m[0])
    return sorted(found)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty if null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.split(F.translate(target, UPPER, LOWER), "[^a-z0-9]+"))


def rule_index(spark: SparkSession, rules: list[Rule], targets: DataFrame) -> DataFrame:
    """(token, rule columns): each rule under its rarest literal token in ``targets`` (target)."""
    rows = [(i, r.name or r.pattern, r.verdict, r.layer, len(r.name or r.pattern), to_regex(r.pattern), literal_tokens(r.pattern) or [""]) for i, r in enumerate(rules)]
    table = spark.createDataFrame(rows, "rule_id long, rule string, verdict string, layer int, length int, regex string, tokens array<string>")
    by_token = table.select("rule_id", F.explode("tokens").alias("token"))
    asked = by_token.select("token").distinct()
    seen = targets.select(F.explode(_tokens(F.col("target"))).alias("token"))
    counts = seen.join(_sent(asked, rules), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = (
        by_token.join(counts, "token", "left")
        .groupBy("rule_id")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    )
    return table.drop("tokens").join(rarest, "rule_id")


def _sent(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return F.broadcast(df) if len(rules) <= BROADCAST_RULES else df


def candidates(targets: DataFrame, index: DataFrame, rules: list[Rule]) -> DataFrame:
    """Targets with each rule that one of their tokens fetches; rules without a literal token are fetched by all."""
    tokens = F.array_union(_tokens(F.col("target")), F.array(F.lit("")))
    return targets.select("host", "path", "target", F.explode(tokens).alias("token")).join(_sent(index, rules), "token")


def judge(urls: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """``urls`` with host, path, rule, verdict and layer of the winning rule (null: none fits); these replace columns of
    the same names."""
    spark = urls.sparkSession
    host, path = host_and_path(F.col(f"`{url_col}`"))
    kept = [f"`{c}`" for c in urls.columns if c not in ("host", "path", "rule", "verdict", "layer")]
    rows = urls.select(*kept, host.alias("host"), path.alias("path"))
    targets = rows.select("host", "path").distinct().withColumn("target", F.concat("host", "path"))
    index = rule_index(spark, rules, targets)
    fits = candidates(targets, index, rules).filter(F.expr("rlike(target, regex)"))
    best = fits.groupBy("host", "path").agg(
        F.min_by(F.struct("rule", "verdict", "layer"), F.struct("layer", -F.col("length"), "rule")).alias("won")
    )
    return rows.join(best, ["host", "path"], "left").select(*kept, "host", "path", "won.rule", "won.verdict", "won.layer")
