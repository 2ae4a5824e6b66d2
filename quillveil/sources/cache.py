"""A table of results by content and settings, with least-recently-used eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Settings

#: key, redacted_path, report_path, found, size, atime
SCHEMA = "key string, redacted_path string, report_path string, found int, size long, atime double"


def cache_key(content_hash: Column, settings: Settings) -> Column:
    return F.concat(content_hash, F.lit(":" + settings.fingerprint()))


def lookup(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (with ``key``) that hit, with their entry, and those that miss.

    An entry with findings but without its copy is no hit.
    """
    sound = cache.filter((F.col("found") == 0) | F.col("redacted_path").isNotNull())
    return requests.join(sound, "key"), requests.join(sound, "key", "left_anti")


def touched(cache: DataFrame, hits: DataFrame, now: float) -> DataFrame:
    """The cache with the access time of hit entries renewed."""
    seen = hits.select("key").distinct().withColumn("_hit", F.lit(True))
    return cache.join(seen, "key", "left").withColumn("atime", F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("atime"))).drop("_hit")


def entries(done: DataFrame, part: str, now: float) -> DataFrame:
    """Entries for contents just redacted (key, redacted_path, found, redacted). Only what has a copy takes room;
    ``report_path`` names the part that holds report and copy."""
    size = F.when(F.col("found") > 0, F.octet_length("redacted")).otherwise(0).cast("long")
    return done.select("key", "redacted_path", F.lit(part).alias("report_path"), F.col("found").cast("int").alias("found"), size.alias("size"), F.lit(float(now)).alias("atime"))


def latest(log: DataFrame) -> DataFrame:
    """The entry of every key that was used last."""
    rest = [c for c in log.columns if c not in ("key", "atime")]
    newest = log.groupBy("key").agg(F.max(F.struct("atime", *rest)).alias("_e"))
    return newest.select(*(F.col(c) if c == "key" else F.col("_e")[c].alias(c) for c in log.columns))


def evicted(cache: DataFrame, budget: int, buckets: int = 256) -> DataFrame:
    """The entries that stay: oldest go until the sizes fit the budget.

    What stays is the longest suffix by access time that fits. Entries are put in buckets by quantiles of the
    access time; totals of buckets are summed in sequence, rows only inside their bucket. Of entries with one access
    time those with the larger key stay, of one key too those whose other columns are larger, so reruns agree.
    """
    cuts = cache.stat.approxQuantile("atime", [i / buckets for i in range(1, buckets)], 0.001) if buckets > 1 else []
    cuts = sorted(set(cuts))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("atime"))) if cuts else F.lit(0)
    rows = cache.withColumn("_bucket", bucket)
    totals = rows.groupBy("_bucket").agg(F.sum("size").alias("_total"))  # one row a bucket
    newer = totals.withColumn("_newer", F.coalesce(F.sum("_total").over(Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    order = ["atime", "key", *(c for c in cache.columns if c not in ("key", "atime"))]
    inside = Window.partitionBy("_bucket").orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = rows.withColumn("_run", F.sum("size").over(inside)).join(F.broadcast(newer.select("_bucket", "_newer")), "_bucket")
    return kept.filter(F.col("_run") + F.col("_newer") <= budget).select(*cache.columns)
