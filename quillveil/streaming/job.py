"""Redaction of a stream of files: one answer a file, from the cache where it can be."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.redact import redact, report_json
from ..operators.rules import RULES, Rule
from ..runtime import delete, exists
from ..schema import Settings
from ..sources.cache import SCHEMA, cache_key, entries, evicted, latest
from ..sources.files import extract_text, output_name

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
#: After so many batches the cache's log becomes one table again, and old entries go.
COMPACT = 16


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(path)


def keyed(rows: DataFrame, settings: Settings) -> DataFrame:
    """Extracted files with their cache ``key``; skipped ones have none."""
    return rows.withColumn("key", F.when(F.col("skip_reason").isNull(), cache_key(F.col("content_hash"), settings)))


def redact_new(rows: DataFrame, held: DataFrame, settings: Settings = Settings(), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The keyed rows whose content the cache does not hold, redacted: of equal contents the one with the smallest path.

    Paths are unique, as a file source gives them.
    """
    first = rows.filter("key is not null").groupBy("key").agg(F.min("path").alias("path"))
    new = rows.join(first.join(held.select("key"), "key", "left_anti"), ["key", "path"], "left_semi")
    name = output_name(F.col("path"), F.col("content_hash"), settings.fingerprint())
    return redact(new, "text", settings, rules).withColumn("redacted_path", F.when(F.col("found") > 0, name))


def answers(rows: DataFrame, held: DataFrame, done: DataFrame) -> DataFrame:
    """path, key, cache_hit, found, redacted_path, skip_reason: one row a file.

    A hit is content that the cache held, or that an earlier file of the batch brought. Skipped files tell why and
    neither hit nor miss.
    """
    told = held.select("key", "found", "redacted_path", F.lit(None).cast("string").alias("_by")).unionByName(done.select("key", "found", "redacted_path", F.col("path").alias("_by")))
    out = rows.select("path", "key", "skip_reason").join(told, "key", "left")
    hit = F.when(F.col("key").isNotNull(), F.col("_by").isNull() | (F.col("_by") != F.col("path")))
    return out.select("path", "key", hit.alias("cache_hit"), "found", "redacted_path", "skip_reason")


def _log(spark: SparkSession, out: str, number: int, compact: int) -> DataFrame:
    """What the batches before ``number`` left: the last compacted table and at most ``compact`` parts."""
    base = number - number % compact
    paths = [f"{out}/cache/table={base - 1}"] * (base > 0) + [f"{out}/cache/batch={n}" for n in range(base, number)]
    return spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)


def _with_copies(held: DataFrame, out: str) -> DataFrame:
    """The entries whose redacted copy is still there; entries without findings need none."""
    spark, needs = held.sparkSession, F.col("found") > 0
    parts = [r.report_path for r in held.filter(needs).select("report_path").distinct().collect()]  # at most one a batch
    paths = [p for p in (f"{out}/redacted/{x}" for x in parts) if exists(spark, p)]
    copies = spark.read.schema("key string").parquet(*paths) if paths else spark.createDataFrame([], "key string")
    return held.filter(~needs).unionByName(held.filter(needs).join(copies, "key", "left_semi"))


def redact_stream(files: DataFrame, out: str, checkpoint: str, settings: Settings = Settings(), compact: int = COMPACT):
    """Starts the job: tables ``answers``, ``redacted``, ``reports`` and ``cache`` below ``out``; ends when all input is read.

    ``answers`` has a row for every file, ``redacted`` and ``reports`` for every new content (``redacted`` only where
    something is found). A batch that is tried again overwrites its own parts. The cache is a log of entries, the newest
    of a key counts; every ``compact`` batches it becomes one table again and the least recently used entries
    beyond ``cache_max_bytes`` go, whose contents are then redacted anew when they come back. Batches already committed
    never run again, so the log behind a compacted table is deleted.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark, now, part = df.sparkSession, time.time(), f"batch={number}"
        if number and number % compact == 0:
            for n in range(number - compact, number):
                delete(spark, f"{out}/cache/batch={n}")
            delete(spark, f"{out}/cache/table={number - compact - 1}")
        rows = keyed(extract_text(df, settings), settings).persist()
        asked = rows.filter("key is not null").select("key").distinct()
        held = _with_copies(latest(_log(spark, out, number, compact)).join(asked, "key", "left_semi"), out).persist()
        done = redact_new(rows, held, settings).persist()
        try:
            answers(rows, held, done).write.mode("overwrite").parquet(f"{out}/answers/{part}")
            done.filter("found > 0").select("key", "path", "redacted_path", "found", "redacted").write.mode("overwrite").parquet(f"{out}/redacted/{part}")
            report_json(done, "path").write.mode("overwrite").parquet(f"{out}/reports/{part}")
            renewed = held.withColumn("atime", F.lit(now))
            renewed.unionByName(entries(done, part, now)).write.mode("overwrite").parquet(f"{out}/cache/{part}")
            if (number + 1) % compact == 0:
                log = _log(spark, out, number, compact).unionByName(spark.read.schema(SCHEMA).parquet(f"{out}/cache/{part}"))
                evicted(latest(log), settings.cache_max_bytes).write.mode("overwrite").parquet(f"{out}/cache/table={number}")
        finally:
            for x in (done, held, rows):
                x.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
