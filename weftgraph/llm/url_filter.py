"""URL filters by a sort-merge range join (DataFrame operations only).

A host is read backwards with a closing dot (``com`` is ``moc.``), so a rule's host and all its
subdomains are one interval of keys, and so are the paths that start with a rule's path. Rules
and keys are range-partitioned together and swept in order. Each rule carries the stack of rules
that enclose it; at a key, the stack of the last rule passed, less those that have ended, are the
rules in force. One sweep over distinct hosts finds the rule hosts, a second over distinct
paths below each of them finds its longest path rule.

Copies of a host or url are swept once, ranges split the keys evenly however many share a
domain, and no side is broadcast but one row per range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, partitions

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def split_url(url: str = "url") -> tuple:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (then
    up to ``?``, ``#`` or the end); both empty for null or without ``://``."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.substring(F.col(url), F.instr(F.col(url), "://") + 3, F.length(F.col(url)))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host) -> F.Column:
    return F.concat(F.reverse(host), F.lit("."))


def prefix_sweep(keys: DataFrame, starts: DataFrame) -> DataFrame:
    """(k, stack) for each distinct ``k`` of ``keys``: the ``k`` of ``starts`` (distinct) that it starts
    with, shortest first; keys without any are left out."""
    n = partitions(keys.sparkSession)
    # The stack that each start leaves on top: itself and the starts that enclose it.
    inner = starts.select("k", F.explode(F.transform(F.sequence(F.lit(1), F.length("k")), lambda i: F.substring("k", F.lit(1), i))).alias("p"))
    stacks = inner.join(starts.select(F.col("k").alias("p")), "p", "left_semi").groupBy("k").agg(F.array_sort(F.collect_list("p")).alias("stack"))
    events = keys.select("k", F.lit(1).alias("kind"), F.lit(None).cast("array<string>").alias("stack")).unionByName(stacks.select("k", F.lit(0).alias("kind"), "stack"))
    events = cut(events.repartitionByRange(n, "k", "kind").withColumn("pid", F.spark_partition_id()))
    # What is open when a range begins: the last start of the ranges before it.
    ends = events.groupBy("pid").agg(F.max(F.when(F.col("kind") == 0, F.struct("k", "stack")))["stack"].alias("last"))
    carry = ends.select("pid", F.last("last", True).over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    sweep = Window.partitionBy("pid").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.select("pid", "k", "kind", F.last("stack", True).over(sweep).alias("top")).where("kind = 1")
    # One row per range: ``n`` at most.
    top = swept.join(F.broadcast(carry), "pid").select("k", F.coalesce("top", "carry").alias("top"))
    return top.select("k", F.filter("top", lambda s: F.col("k").startswith(s)).alias("stack")).where(F.size("stack") > 0)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with
    the rule's. The longest rule wins (host and path together; of equal lengths the longer host),
    ``default`` where none fits. Rules given twice: block wins. Rules without a host are ignored,
    a null path is empty. A url that is null or has no ``://`` has an empty host, which no rule fits.
    Repeated pages come back as often as they came; an empty table gives an empty result.
    """
    host, path = split_url(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rules = rules.where(F.coalesce(F.col("host"), F.lit("")) != "").select(ascii_lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("hk", host_key(F.col("host")))
    urls = rows.where("host <> ''").select("host", "path").distinct()
    hosts = urls.select(host_key(F.col("host")).alias("k")).distinct()
    over = prefix_sweep(hosts, rules.select(F.col("hk").alias("k")).distinct())
    below = cut(
        urls.withColumn("k", host_key(F.col("host"))).join(over, "k").select("host", "path", F.explode("stack").alias("hk")).withColumn("k", F.concat("hk", F.lit("/"), "path"))
    )
    fits = prefix_sweep(below.select("k").distinct(), rules.select(F.concat("hk", F.lit("/"), "path").alias("k")))
    found = below.join(fits.select("k", F.try_element_at("stack", F.lit(-1)).alias("rk")), "k").join(rules.select(F.concat("hk", F.lit("/"), "path").alias("rk"), F.col("host").alias("rh"), F.col("path").alias("rp"), "verdict"), "rk")
    best = found.groupBy("host", "path").agg(
        F.max(F.struct((F.length("rh") + F.length("rp")).alias("len"), F.length("rh").alias("hlen"), F.concat("rh", "rp").alias("rule"), "verdict")).alias("b")
    )
    return rows.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
