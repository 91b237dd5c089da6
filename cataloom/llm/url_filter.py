"""URL allow and block rules, with DataFrame functions only.

A URL is expanded into expressions host-suffix x path-prefix, as public safe
browsing lists do: every suffix of the host at a label border, and every path
prefix that a rule could have (those that end at a ``/``, the whole path, and
the lengths of rules that end elsewhere).  Expressions meet the rules by an
equi join on a 32-bit hash prefix; the full SHA-256 digest confirms a match,
then the longest rule wins.  Distinct URLs are expanded once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cataloom.llm.common import ascii_lower, own_names
from cataloom.operators.util import bounded_rows

#: A rule list up to this many rows is broadcast (about 60 bytes a row: 12 MB);
#: a longer one is joined by shuffle, where adaptive execution splits hot prefixes.
BROADCAST_RULES = 200_000
#: Bits of the digest that the join uses.
PREFIX_HEX = 8


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) literals as a frame."""
    if not rules:
        return spark.range(0).select(*(F.lit("").alias(c) for c in ("verdict", "host", "path")))
    rows = F.array(*(F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"),
                              F.lit(p).alias("path")) for v, h, p in rules))
    return spark.range(1).select(F.inline(rows))


def split_url(url) -> tuple:
    """(host, path) columns: host after the first ``://`` up to / ? # or the end,
    A-Z lower-cased; path up to ? # or the end; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return (F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit("")),
            F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")))


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """urls (url, ...) -> all their columns plus host, path, rule, verdict.

    A rule (verdict, host, path) fits its host and all subdomains when the
    path starts with the rule's path; the longest (host and path characters,
    then the longer host) wins, at equal length ``block`` goes first.  No rule:
    rule null, verdict ``default``.  Null urls have empty host and path and fit
    no rule.  Rules with a null part are ignored; columns of the input named
    host, path, rule or verdict are replaced, others of any name stay.  URLs of any
    length are read whole.  Empty tables give no rows."""
    keep = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = split_url(F.col("url"))
    base = urls.select(*keep, host.alias("host"), path.alias("path"))
    h, p, hit = own_names(base, "h", "p", "hit")

    r = (rules.select("verdict", ascii_lower(F.col("host")).alias("rh"), F.col("path").alias("rp"))
         .dropna().select("verdict", "rh", "rp", _digest(F.col("rh"), F.col("rp")).alias("full"))
         .withColumn("short", F.substring("full", 1, PREFIX_HEX)))
    # Lengths of rule paths that end inside a path segment: a set of small
    # numbers, bounded by the longest URL path, not by the number of rules.
    odd = [x["n"] for x in r.filter(~F.col("rp").endswith("/"))
           .select(F.length("rp").alias("n")).distinct().orderBy("n").collect()]

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    chars = F.sequence(F.lit(1), F.length("path"))
    ends = F.when(F.length("path") > 0, F.filter(
        chars, lambda i: F.col("path").substr(i, F.lit(1)) == "/")).otherwise(
            F.array().cast(T.ArrayType(T.IntegerType())))
    inside = F.array(*map(F.lit, odd)).cast(T.ArrayType(T.IntegerType()))
    lengths = F.array_distinct(F.concat(
        ends, F.filter(inside, lambda n: n <= F.length("path")), F.array(F.length("path"))))
    exprs = (base.select("host", "path").filter("host <> ''").distinct()
             .select("host", "path", F.explode(suffixes).alias("h"), lengths.alias("ls"))
             .select("host", "path", "h", F.explode("ls").alias("n"))
             .select("host", "path", _digest(F.col("h"), F.expr("substring(path, 1, n)")).alias("e"))
             .withColumn("short", F.substring("e", 1, PREFIX_HEX)))
    if bounded_rows(r, BROADCAST_RULES) is not None:
        r = F.broadcast(r)
    hits = (exprs.join(r, "short").filter("e = full")
            .groupBy("host", "path")
            .agg(F.max(F.struct((F.length("rh") + F.length("rp")).alias("n"),
                                F.length("rh").alias("m"),
                                (F.col("verdict") == "block").alias("b"),
                                "verdict", F.concat("rh", "rp").alias("rule"))).alias("w"))
            .select(F.col("host").alias(h), F.col("path").alias(p), F.col("w").alias(hit)))
    return (base.join(hits, (F.col("host") == F.col(h)) & (F.col("path") == F.col(p)), "left")
            .select(*keep, "host", "path", F.col(hit)["rule"].alias("rule"),
                    F.coalesce(F.col(hit)["verdict"], F.lit(default)).alias("verdict")))
