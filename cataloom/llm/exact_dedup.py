"""Exact de-duplication by a tree merge of sorted digest runs, with DataFrame
functions only.

1. One scan turns every text into (run, digest, length, check digest); the run is
   the scan partition, sorted by digest and written once.
2. Rounds of a binomial exchange.  In each, ``fan_in`` runs that differ in the lowest
   digit of the run number meet, and each of the tasks that held them takes one range
   of their digests: the rows are dealt by (run, range) only, never by digest, sorted,
   and neighbours of one digest are folded to the identifier that stays, the number of
   copies and the smallest and largest check digest.  After ceil(log(runs) /
   log(fan_in)) rounds one run is left, in as many ranges as there were runs, so no task
   ever holds more than its share of the digests.  Level 0 folds each run by itself.
3. The winner travels back down the same tree, so a text that fills a third of
   the table meets its rows run by run, never in one task.

Equal digests are verified at every level: byte length is part of the key and
an independent digest (MD5) of the text must be the same for the whole group;
otherwise the job stops with an error instead of merging different texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.common import ascii_lower, written

FAN_IN = 16
KEY = ["digest", "n_bytes"]


def digest_runs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Sorted digest runs (run, digest, n_bytes, chk, id), written once."""
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    runs = (df.select(F.col(id_col).alias("id"), norm.alias("t"))
            .select("id", F.unhex(F.sha2("t", 256)).alias("digest"),
                    F.octet_length("t").cast("long").alias("n_bytes"),
                    F.unhex(F.md5("t")).alias("chk"),
                    F.spark_partition_id().cast("long").alias("run"))
            .sortWithinPartitions("digest"))
    return written(runs, "digest-runs")


def _merge(rows: DataFrame, pick, ranges: int) -> DataFrame:
    """One row for each (run, digest), verified: the rows of a run are dealt to ``ranges``
    digest ranges, sorted, and neighbours are folded.  Binary check digests make Spark fold
    the sorted rows one after the other (a sort aggregate), without a hash table."""
    head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    part = F.shiftright(head * F.lit(ranges), 32).alias("part")
    dealt = rows.select("run", part, *KEY, "best", "n", "lo", "hi").repartition("run", "part")
    return (dealt.sortWithinPartitions("run", "part", *KEY).groupBy("run", "part", *KEY)
            .agg(pick("best").alias("best"), F.sum("n").alias("n"),
                 F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .filter(F.when(F.col("lo") == F.col("hi"), F.lit(True))
                    .otherwise(F.raise_error(F.lit("digest collision")).cast("boolean")))
            .drop("part"))


def exact_dedup(df: DataFrame, id_col: str, text_col: str, keep: str = "min",
                fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` is "min" or "max": which identifier of equal texts stays.  Texts
    are equal when identical after lower-casing A-Z; null counts as empty.
    Null identifiers never win against others; a group of null identifiers
    only has keep_id null and nothing kept.  Rows that repeat the kept
    identifier with the same text are all kept (they are one document).  An
    empty table gives no rows.  Other columns are ignored."""
    pick = {"min": F.min, "max": F.max}[keep]
    rows = digest_runs(df, id_col, text_col)
    n_runs = (rows.agg(F.max("run")).first()[0] or 0) + 1  # one number
    level = written(_merge(rows.select("run", *KEY, F.col("id").alias("best"),
                                       F.lit(1).cast("long").alias("n"),
                                       F.col("chk").alias("lo"), F.col("chk").alias("hi")), pick, 1),
                    "level")
    levels, ranges = [level], 1
    while n_runs > 1:
        n_runs, ranges = -(-n_runs // fan_in), ranges * fan_in
        level = written(_merge(level.withColumn("run", F.expr(f"run div {fan_in}")), pick, ranges),
                        "level")
        levels.append(level)
    win = levels[-1].select("run", *KEY, "best", "n")
    for below in reversed(levels[:-1]):
        win = (below.select(F.col("run").alias("r"), F.expr(f"run div {fan_in}").alias("run"), *KEY)
               .join(win, ["run", *KEY]).select(F.col("r").alias("run"), *KEY, "best", "n"))
    return (rows.select("run", *KEY, "id").join(win, ["run", *KEY])
            .select("id", F.col("best").alias("keep_id"), F.col("n").alias("group_size"),
                    F.coalesce(F.col("id") == F.col("best"), F.lit(False)).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))
