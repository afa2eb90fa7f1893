"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a host and a path prefix. The literal tokens of a rule that stand whole in every URL it fits (all of its host,
and those of its path that the prefix does not cut) are counted over the tokens of all URLs; the rule is filed under the
rarest. A URL's tokens fetch candidate rules, and only those run their regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """verdict is allow or block; the rule fits host and its subdomains where the URL's path starts with path."""

    verdict: str
    host: str
    path: str = ""

    @property
    def pattern(self) -> str:
        """Java regular expression on host followed by path; hosts hold no slash, and a path is empty or starts with one."""
        quoted = "".join(c if c.isalnum() or c in "/_" else f"\\x{{{ord(c):x}}}" for c in self.host)
        path = "".join(c if c.isalnum() or c in "/_" else f"\\x{{{ord(c):x}}}" for c in self.path)
        return f"^(?:[^/]*\\.)?{quoted}{path or '(?=/|$)'}"

    @property
    def tokens(self) -> list[str]:
        whole = re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", self.path)
        return sorted({*re.findall(r"[A-Za-z0-9]+", self.host), *whole}) or [""]


#: The rules of the registered query: fixed values.
RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def host_and_path(url: str = "url") -> list:
    """Host (A-Z lowered) and path columns; both empty for null or where `://` is missing."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(F.col(url), F.lit(""))
    return [F.translate(F.regexp_extract(text, whole, 1), _UPPER, _UPPER.lower()).alias("host"), F.regexp_extract(text, whole, 2).alias("path")]


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(r.host + r.path, r.verdict, r.pattern, len(r.host) + len(r.path), r.tokens) for r in rules]
    return spark.createDataFrame(rows, "rule string, rule_verdict string, pattern string, rule_length int, tokens array<string>")


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of pages.

    pages: page_id, url. rules: a list, or a table as rule_table gives for more rules than fit a driver. Of several rules
    that fit a URL the longest wins, ties go to the rule that is later in code point order, then to block; where none fits,
    rule is null and verdict the default. A null or malformed URL has an empty host and path, which no rule with a host
    fits. An empty table gives an empty result; repeated pages give a row each; other columns are ignored.
    """
    table = rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules)
    judged = pages.select("page_id", *host_and_path())
    places = judged.select("host", "path").distinct()
    token = F.explode(F.array_distinct(F.concat(F.split(F.concat_ws("/", "host", "path"), "[^A-Za-z0-9]+"), F.array(F.lit("")))))
    asked = places.select("host", "path", token.alias("token"))

    # rules filed under the token that the fewest different URLs have
    rule_tokens = table.select("rule", "rule_verdict", "pattern", "rule_length", F.explode("tokens").alias("token"))
    common = asked.join(rule_tokens.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    weighed = rule_tokens.join(common, "token", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    filed = weighed.groupBy("rule", "rule_verdict", "pattern", "rule_length").agg(F.min_by("token", F.struct("count", "token")).alias("token"))

    fits = asked.join(filed, "token").where(F.expr("rlike(concat(host, path), pattern)"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("rule_length", "rule", "rule_verdict")).alias("best"))
    found = judged.join(best, ["host", "path"], "left")
    return found.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
