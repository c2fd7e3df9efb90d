"""URL rules by hashed host-suffix and path-prefix expressions.

A rule is a host, a path and an action; it fits its host and all subdomains if the path of a URL
starts with the rule's. Each distinct host and (shortened) path is expanded into every host suffix
that has as many labels as some rule's host, with every path prefix that is as long as some rule's path,
so what a URL costs follows from the rules and its length, not from the square of it. The expressions meet the rules on the
first 32 bits of their SHA-256; the full digests are then compared, and of the rules that fit the
longest wins (of equally long ones that with the longer host, then block before allow).

Edge cases: a null URL or one without ``://`` has empty host and path, which only a rule with an
empty host could fit; hosts and paths of any length are judged whole; repeated pages each get a row; without rules every URL gets the default;
other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.operators.skew import attach

# Rule tables up to so many rows (well under 100 MB) are broadcast, larger ones shuffled.
BROADCAST_RULES = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host after the first ``://`` with A-Z lower-cased, and path before any query or fragment."""
    rest = F.when(F.locate("://", url) > 0, F.substring_index(url, "://", 1)).otherwise(F.lit(None))
    after = F.when(rest.isNotNull(), F.substring(url, F.length(rest) + 4, F.length(url)))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) per page for rules (host, path, action)."""
    host, path = host_and_path(F.col("url"))
    rules = rules.select(
        F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), F.col("path").alias("rule_path"), "action", "host"
    )
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())  # at most a path's length
    split = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn(
        "start", F.substring("path", 1, max(lengths, default=0))
    )
    digest = F.sha2("rule", 256)
    hashed = rules.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, 8)).drop("rule_path", "host")
    labels = lambda column: F.length(column) - F.length(F.translate(column, ".", "")) + 1
    depths = [r[0] for r in rules.select(labels(F.col("host"))).distinct().collect()]  # at most a host's labels
    suffixes = F.array_compact(
        F.array(*[F.when(labels(F.col("host")) >= n, F.substring_index("host", ".", -n)) for n in sorted(depths)])
        if depths else F.array().cast("array<string>")
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("start")),
        lambda n: F.substring(F.col("start"), F.lit(1), n),
    )
    expressions = (
        split.select("host", "start")
        .distinct()
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("expression", F.sha2(F.concat("suffix", "prefix"), 256))
        .select("host", "start", "expression", F.substring("expression", 1, 8).alias("short"))
    )
    met = expressions.join(F.broadcast(hashed) if rules.count() <= BROADCAST_RULES else hashed, "short").where(
        F.col("expression") == F.col("digest")
    )
    best = met.groupBy("host", "start").agg(
        F.max(F.struct(F.length("rule").alias("length"), "host_length", "action", "rule")).alias("best")
    )
    return attach(split, best, ["host", "start"], ["page_id", "path"], how="left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
