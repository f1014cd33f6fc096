"""URL filter: pattern rules, indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens
that every match of it contains whole.  Of those tokens the one that the
fewest URLs have (counted over all of them) indexes the rule.  The tokens of a
URL fetch the rules indexed by them, and only these are run.

Only DataFrame functions are used.  Rules come as a table, so a large rule set
is joined by shuffle and a small one is broadcast by size, as Spark decides.

Cases: a null url, or one without ``://``, has an empty host and path and no
rule; equal urls are judged once and joined back, however many rows share one;
equally long rules are told apart by their text; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivena.plans.staging import stage

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN_EDGE = "[^a-z0-9]+"

# Rules by host suffix and path prefix: (verdict, host, path).
SITE_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
# Patterns that judge what no site rule fits: (verdict, pattern, literal tokens that a match has whole).
PATTERN_RULES = [
    ("block", r"^(?:[^/]*[.-])?spam[.-]", ["spam"]),
    ("block", r"^(?:[^/]*[.-])?(?:cheap-)?pills[.-]", ["pills"]),
    ("block", r"^(?:[^/]*[.-])?casino[.-]", ["casino"]),
    ("block", r"^(?:[^/]*[.-])?porn[.-]", ["porn"]),
    ("block", r"^(?:[^/]*[.-])?malware-", ["malware"]),
    ("block", r"^(?:[^/]*[.-])?phishing-", ["phishing"]),
]
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWERED), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_table(spark: SparkSession, site_rules=SITE_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """(id, rule, verdict, pattern, rank, tokens): of the rules that fit a URL the highest rank decides.

    A site rule's rule is its host and path and its rank their length; a pattern's rule is null, its rank 0.
    A path's last token may go on in the URL and is no literal token unless an edge follows it.
    """
    rows = []
    for verdict, host, path in site_rules:
        whole = [t for t in re.split(TOKEN_EDGE, host) if t] + [t for t in re.split(TOKEN_EDGE, path)[:-1] if t]
        rows.append((len(rows), host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host + path)}", len(host + path), whole))
    for verdict, pattern, tokens in pattern_rules:
        rows.append((len(rows), None, verdict, pattern, 0, tokens))
    return spark.createDataFrame(rows, "id int, rule string, verdict string, pattern string, rank int, tokens array<string>")


def _tokens(key: Column) -> Column:
    """Different tokens of a host and path, with the empty one, which indexes rules that have no literal token."""
    return F.array_distinct(F.concat(F.split(F.translate(key, UPPER, LOWERED), TOKEN_EDGE), F.array(F.lit(""))))


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages`` (page_id, url)."""
    urls = pages.select("url").filter("url is not null").distinct().select("url", F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("key")).filter("key <> ''")
    spread = urls.select("url", "key", F.explode(_tokens(F.col("key"))).alias("token"))

    literals = rules.select("id", F.explode_outer("tokens").alias("token")).withColumn("token", F.coalesce("token", F.lit("")))
    seen = spread.join(literals.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    rarest = (
        literals.join(seen, "token", "left")
        .groupBy("id")
        .agg(F.min(F.struct(F.when(F.col("token") == "", F.lit(1 << 62)).otherwise(F.coalesce("urls", F.lit(0))).alias("urls"), "token")).alias("least"))
        .select("id", "least.token")
    )
    index = rules.join(rarest, "id").select("token", "id", "rule", "verdict", "pattern", "rank")
    fits = spread.join(index, "token").filter(F.regexp_like("key", F.col("pattern")))
    first = F.max_by(F.struct("rule", "verdict"), F.struct("rank", F.coalesce("rule", F.lit("")), -F.col("id")))
    # Staged before it is joined back, so that a url with very many rows can be split in the join.
    chosen = stage(fits.groupBy("url").agg(first.alias("found")).select("url", "found.rule", "found.verdict"), "url-chosen")
    rows = pages.select("page_id", "url").join(chosen, "url", "left")
    return rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
