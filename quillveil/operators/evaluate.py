"""Recall, release gate, false positives and leaks against labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import RELEASE_BLOCKING_TYPES


def leaks(truth: DataFrame, outputs: DataFrame) -> DataFrame:
    """truth (doc, value, entity_type) with ``leaked``: the value occurs in any output (doc, output) of its document."""
    joined = truth.join(outputs, "doc", "left")
    return joined.groupBy("doc", "value", "entity_type").agg(F.coalesce(F.bool_or(F.col("output").contains(F.col("value"))), F.lit(False)).alias("leaked"))


def recall_by_type(judged: DataFrame) -> DataFrame:
    caught = F.sum((~F.col("leaked")).cast("long"))
    return judged.groupBy("entity_type").agg(caught.alias("caught"), F.count(F.lit(1)).alias("total")).withColumn("recall", F.col("caught") / F.col("total"))


def release_gate(recall: DataFrame) -> DataFrame:
    """Each release-blocking type: it must occur and be caught every time."""
    types = recall.sparkSession.createDataFrame([(t,) for t in RELEASE_BLOCKING_TYPES], "entity_type string")
    joined = types.join(recall, "entity_type", "left")
    return joined.select(
        "entity_type",
        F.coalesce("caught", F.lit(0)).cast("long").alias("caught"),
        F.coalesce("total", F.lit(0)).cast("long").alias("total"),
        "recall",
        F.coalesce(F.col("recall") == 1.0, F.lit(False)).alias("ok"),
    )


def false_positives(report: DataFrame, controls: DataFrame, public: tuple[str, ...]) -> DataFrame:
    """Per control document with findings: how many, and which types."""
    hits = report.join(controls.select("doc"), "doc", "left_semi").filter(~F.col("entity_type").isin(*public))
    return hits.groupBy("doc").agg(F.count(F.lit(1)).alias("found"), F.array_join(F.array_sort(F.collect_set("entity_type")), ",").alias("types"))
