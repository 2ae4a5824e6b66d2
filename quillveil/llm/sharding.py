"""Sharding by sampled splitters.

Size-weighted key samples give quantile boundaries; records are range-partitioned by
(text_crc32, doc_id), so equal texts stay neighbours; ranges that turn out overfull are sampled
again and subdivided. Inside the ranges exact running sums of the sizes deal rows to shards.

Law ``bytes``: shard = floor(16 * bytes before the row / all bytes), so shard sizes differ by at
most one row's size. Size is the UTF-8 length plus 1 (null text: 1). Ties in the key are identical
rows; they are counted as one weighted record and dealt out one by one. A null id sorts first.
An empty table gives an empty result. Only the id and the text are read.

What reaches the driver is bounded by ``ranges`` and ``samples``, whatever the size of the input.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize


def _key() -> Column:
    return F.struct(F.col("text_crc32").alias("a"), F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("b"))


def _long(x: int) -> str:
    return f"{x}L" if x > -(2**63) else "(-9223372036854775807L - 1L)"


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """Number of boundaries <= the key, by binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    arr = F.expr("array(" + ",".join(f"named_struct('a',{a}L,'b',{_long(b)})" for a, b in bounds) + ")")
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]

    def step(lo: Column, jump: Column) -> Column:
        there = lo + jump
        hit = (there <= len(bounds)) & (F.get(arr, F.least(there, F.lit(len(bounds))) - 1) <= _key())
        return F.when(hit, there).otherwise(lo)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def _sample(rows: DataFrame, total: int, want: int, seed: int) -> list[tuple[int, int, float]]:
    """Poisson sample with inclusion probability proportional to size: about ``want`` rows, with weights."""
    p = F.least(F.lit(1.0), F.col("w") * (want / total))
    u = (F.xxhash64(F.lit(seed), "text_crc32", "doc_id").bitwiseAND((1 << 52) - 1)) / float(1 << 52)
    got = rows.select(_key().alias("k"), (F.col("w") / p).alias("weight")).filter(u < p).collect()
    return sorted((r.k.a, r.k.b, r.weight) for r in got)


def _quantiles(sample: list[tuple[int, int, float]], parts: int) -> list[tuple[int, int]]:
    total, run, out = sum(w for *_, w in sample), 0.0, []
    for a, b, w in sample:
        if run >= total * (len(out) + 1) / parts:
            out.append((a, b))
        run += w
    return out


def shard(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 16,
    ranges: int = 512,
    samples: int = 8192,
    rounds: int = 3,
    least_rows: int = 1000,
) -> DataFrame:
    """Every row with doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = materialize(
        docs.select(docs[id_col].cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
        .groupBy("text_crc32", "doc_id", "size")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("w", F.col("size") * F.col("copies")),
        "shard-rows",
    )
    total = rows.agg(F.sum("w")).first()[0] or 0
    bounds = _quantiles(_sample(rows, total, samples, 0), ranges) if total else []
    for r in range(rounds + 1):
        ranged = rows.withColumn("range", _range_of(bounds))
        sizes = {x["range"]: (x["w"], x["n"]) for x in ranged.groupBy("range").agg(F.sum("w").alias("w"), F.sum("copies").alias("n")).collect()}
        over = [k for k, (w, n) in sizes.items() if w > 2 * total / ranges and n > least_rows]
        if not over or r == rounds:
            break
        inside = ranged.filter(F.col("range").isin(over))
        extra = _sample(inside, sum(sizes[k][0] for k in over), 32 * len(over), r + 1)
        by: dict[int, list] = {}
        for s in extra:
            by.setdefault(bisect.bisect_right(bounds, s[:2]), []).append(s)
        new = {b for k, s in by.items() for b in _quantiles(s, min(32, 2 + int(sizes[k][0] * ranges / total)))}
        if not new - set(bounds):
            break
        bounds = sorted(set(bounds) | new)

    before, w0, n0 = [], 0, 0
    for k in sorted(sizes):
        before.append((k, w0, n0))
        w0, n0 = w0 + sizes[k][0], n0 + sizes[k][1]
    spark = docs.sparkSession
    starts = spark.createDataFrame(before, "range int, bytes_before long, rows_before long")
    order = Window.partitionBy("range").orderBy("text_crc32", "doc_id", "size")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = materialize(
        ranged.withColumns({"cw": F.sum("w").over(upto) - F.col("w"), "cn": F.sum("copies").over(upto) - F.col("copies")})
        .join(F.broadcast(starts), "range")  # at most as many rows as there are ranges
        .select("doc_id", "size", "text_crc32", "bytes_before", "cw", "rows_before", "cn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("i"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            (F.col("rows_before") + F.col("cn") + F.col("i")).alias("place"),
            # integer division, exact for totals up to 2**63 / shards
            F.expr(f"cast(((bytes_before + cw + i * size) * {shards}L) div {max(total, 1)}L as int)").alias("shard"),
        ),
        "shard-placed",
    )
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # one row per shard
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
