"""URL rules by hashed host-suffix and path-prefix expressions.

A URL is expanded into expressions (a suffix of its host, cut at dots, and a prefix of its path that ends with a
slash). They meet the rules in an equi-join on the first four bytes of a digest; the full digest and the rest of the
rule's path then confirm a hit, and the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small

#: (verdict, host, path): the rules of the registered query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    return F.translate(_part(url, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return _part(url, 2)


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), folder), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each page: page_id, host, path, rule (``host`` + ``path``, or null), verdict.

    ``rules`` has verdict, host and path. A rule fits its host and all subdomains where the URL's path starts with the
    rule's. The longest rule wins (by characters of host and path, then of the host, then block before allow); no rule:
    ``default``. A null URL, or one without ``://``, has an empty host and path and takes ``default``. Repeated rows
    are judged each; null ids are kept; an empty rule table leaves all at ``default``; other columns are not read.

    No expression is left out: a host gives all suffixes and a path all prefixes up to the greatest number of labels
    and slashes in any rule, beyond which none can match. Equal URLs are expanded once (combined before the shuffle),
    so a hot URL costs a row a task. Rules are broadcast only if counted few; else Spark's skew join splits hot ones.
    Pages are joined by a digest of the URL; those without a host take no part in joins.
    """
    hashed = rules.select(
        F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict"), F.col("path").alias("rule_path"), F.length("host").alias("host_length"),
        _digest(F.col("host"), F.regexp_extract("path", r"(?s)^(.*/)?", 0)).alias("rule_digest"),
        F.size(F.split("host", r"\.")).alias("labels"), (F.size(F.split("path", "/")) - 1).alias("slashes"),
    )
    reach = hashed.agg(F.count("*").alias("n"), F.max("labels").alias("labels"), F.max("slashes").alias("slashes")).first()
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(reach["labels"] or 1))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    steps = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.least(F.size(steps) - 1, F.lit(reach["slashes"] or 0))), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, 1, k), "/"), F.lit("/"))))
    parts = parts.select("page_id", "host", "path", F.when(F.col("host") != "", F.unhex(F.sha2("url", 256))).alias("url"))
    urls = parts.where("url is not null").groupBy("url").agg(F.first("host").alias("host"), F.first("path").alias("path"))
    digests = urls.select("url", "path", F.explode(suffixes).alias("suffix"), folders.alias("folders")).select("url", "path", "suffix", F.explode("folders").alias("folder")).select("url", "path", _digest(F.col("suffix"), F.col("folder")).alias("digest"))
    hits = (
        digests.withColumn("short", _short(F.col("digest")))
        .join(small(hashed.withColumn("short", _short(F.col("rule_digest"))), reach["n"], 256), "short")
        .where((F.col("digest") == F.col("rule_digest")) & F.expr("startswith(path, rule_path)"))
    )
    order = F.struct(F.length("rule"), "host_length", "rule_verdict", "rule")
    best = hits.groupBy("url").agg(F.max_by(F.struct("rule", "rule_verdict"), order).alias("best"))
    met = parts.where("url is not null").join(best, "url", "left")
    rest = parts.where("url is null").withColumn("best", F.lit(None).cast("struct<rule: string, rule_verdict: string>"))
    return met.unionByName(rest).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
