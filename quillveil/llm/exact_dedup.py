"""Exact dedup: group by a 128-bit content hash, keep one stable row, compare bytes inside groups.

Texts are equal when identical after lower-casing A-Z only; null counts as the empty text. Of
equal texts the row with the largest id stays (null ids come before all others). Rows repeated
with the same id count each, and one of them stays. An empty table gives an empty result.
Columns other than the id and the text never enter the operator, so any names may occur.

Plan: ids and hashes are written as narrow rows. Only hashes that occur more than once have their texts looked at:
those rows alone bring their bytes, and an aggregation on (hash, bytes), whose map side collapses copies, tells a
collision from a copy. Lists of such hashes, and of the rows that go, are broadcast while they are short (``SHORT``
rows, counted first) and joined by key beyond, where AQE can split a class with a third of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import fresh, materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of the longest list that is broadcast: some 20 MB of hashes and ids.
SHORT = 200_000


def normalized(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def _short(rows: DataFrame) -> DataFrame:
    """A written list, to be broadcast if it is short."""
    return F.broadcast(rows) if rows.count() <= SHORT else rows


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One narrow row per row: uid (written, so it stays), doc_id, h128, sha, keep_id, group_size."""
    norm = normalized(docs[text_col])
    narrow = materialize(docs.select(F.monotonically_increasing_id().alias("uid"), docs[id_col].alias("doc_id"), F.md5(norm).alias("h128"), F.sha2(norm, 256).alias("sha")), "exact-rows")
    several = materialize(narrow.groupBy("h128").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h128"), "exact-several")
    wide = docs.select(F.md5(norm).alias("h128"), norm.alias("norm"), docs[id_col].alias("doc_id")).join(_short(several), "h128", "left_semi")
    # the bytes are part of the key: a hash collision stays two groups
    groups = wide.groupBy("h128", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    copies = materialize(groups.select("h128", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size").filter("group_size > 1"), "exact-copies")
    met = narrow.join(_short(copies), ["h128", "sha"], "left")
    alone = F.col("group_size").isNull()
    return met.select("uid", "doc_id", "h128", "sha", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its class: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialize(_classes(docs, id_col, text_col), "exact-classes")
    own = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    # rows that could stay are one a class, unless rows repeat with the same id and text: then the first of them
    several = rows.filter(own & (F.col("group_size") > 1)).groupBy("h128", "sha").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("n"))
    again = materialize(several.filter("n > 1").select("h128", "sha", "first"), "exact-again")
    kept = own & (F.col("first").isNull() | (F.col("uid") == F.col("first")))
    return rows.join(_short(again), ["h128", "sha"], "left").select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Rows that go are told by hash and id, so those that stay need no shuffle."""
    h, s = (fresh(docs.columns, f"_exact_{x}") for x in ("h", "s"))
    norm, own = normalized(F.col(text_col)), F.col("doc_id").eqNullSafe(F.col("keep_id"))
    classes = materialize(_classes(docs, id_col, text_col).filter("group_size > 1"), "exact-classes")
    key = [F.col("h128").alias("gone_h"), F.col("sha").alias("gone_s"), F.col("doc_id").alias("gone_id")]
    gone = materialize(classes.filter(~own).select(*key).distinct(), "exact-gone")
    again = materialize(classes.filter(own).groupBy("h128", "sha", "doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key), "exact-again")
    rows = docs.withColumns({h: F.md5(norm), s: F.sha2(norm, 256)})

    def same(listed: DataFrame) -> Column:
        return (rows[h] == listed["gone_h"]) & (rows[s] == listed["gone_s"]) & rows[id_col].eqNullSafe(listed["gone_id"])

    stay = rows.join(_short(gone), same(gone), "left_anti")
    if again.isEmpty():
        return stay.select(*docs.columns)
    # of rows that repeat, any one; the map side keeps one a task
    repeated = stay.join(_short(again), same(again), "left_semi").groupBy(h, s, id_col).agg(F.first(F.struct(*docs.columns)).alias("row"))
    return stay.join(_short(again), same(again), "left_anti").select(*docs.columns).unionByName(repeated.select("row.*"))
